"""The append-only journal as a stateful stream: completed keys are final, failed ones may be tried again.

Per key the state store holds how many events were appended and the latest
status; a batch costs what its own events cost, however long the journal is.
Every event leaves with an ``outcome``, so a refused one is told rather than lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

STATUSES = ("completed", "failed")
#: What became of an event.
APPENDED, COMPLETED, NO_RETRY, BAD_STATUS, BAD_ATTEMPT = "appended", "already completed", "retry not allowed", "invalid status", "wrong attempt"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HISTORY = "attempts int, latest string, failures int"


def verdicts(statuses: list, supplied: list, attempts: int, latest: str | None, allow_retry: bool) -> tuple[list[str], list[int | None], int, str | None]:
    """Outcome and attempt of a key's events in order, after ``attempts`` events of which the last had status ``latest``; and the state after them."""
    outcomes, numbers = [], []
    for status, given in zip(statuses, supplied, strict=True):
        number = None
        if status not in STATUSES:
            outcome = BAD_STATUS
        elif latest == "completed":
            outcome = COMPLETED
        elif latest == "failed" and not allow_retry:
            outcome = NO_RETRY
        elif not pd.isna(given) and given != attempts + 1:
            outcome = BAD_ATTEMPT
        else:
            outcome, attempts, latest = APPENDED, attempts + 1, status
            number = attempts
        outcomes.append(outcome)
        numbers.append(number)
    return outcomes, numbers, attempts, latest


class History(StatefulProcessor):
    """Decides a key's events of a batch, in order of ``seq``, by one value of state."""

    def __init__(self, names: list[str], allow_retry: bool, supplied: bool):
        self.names, self.allow_retry, self.supplied = names, allow_retry, supplied

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getValueState("history", HISTORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)  # one key's events of one batch
        attempts, latest, failures = self.history.get() if self.history.exists() else (0, None, 0)
        given = events["attempt"].tolist() if self.supplied else [None] * len(events)
        outcomes, numbers, after, latest = verdicts(events["status"].tolist(), given, attempts, latest, self.allow_retry)
        if after > attempts:
            failed = sum(o == APPENDED and s == "failed" for o, s in zip(outcomes, events["status"], strict=True))
            self.history.update((after, latest, failures + failed))
        yield events[self.names].assign(attempt=pd.array(numbers, "Int32"), outcome=outcomes)

    def close(self) -> None:
        pass


def decided(events: DataFrame, *key: str, allow_retry: bool = True) -> DataFrame:
    """A stream of events (``key`` columns, ``seq``, ``status``, any others) with ``attempt`` and ``outcome``.

    Batches come in the order of the journal, and within a batch a key's
    events in order of ``seq`` (equal ones as they arrive). The status must be
    completed or failed; nothing follows a completed event; without
    ``allow_retry`` nothing follows a failed one; an ``attempt`` that comes with an event must be the
    next number of its key (null: not given). A null key is a key of its own. Run it by ``append_stream`` or ``decide_stream``, which sets the state store.
    """
    names = [c for c in events.columns if c != "attempt"]
    schema = T.StructType([*(f for f in events.schema if f.name != "attempt"), T.StructField("attempt", T.IntegerType()), T.StructField("outcome", T.StringType())])
    return events.groupBy(*key).transformWithStateInPandas(History(names, allow_retry, "attempt" in events.columns), schema, "Append", "None")


def run_stream(rows: DataFrame, path: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Start writing a stream to Parquet at ``path``, in folders by ``by``; what is there is taken, then it ends.

    The sink's own log makes a batch that is run again after a failure appear
    once; the state store goes back to the version of the last batch that was committed.
    """
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)  # a query takes a copy of the settings as it starts
    try:
        writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.partitionBy(*by) if by else writer).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_stream(events: DataFrame, path: str, checkpoint: str, *key: str, allow_retry: bool = True) -> StreamingQuery:
    """Append a stream of events to the Parquet journal at ``path``; refused events are left out."""
    rows = decided(events, *key, allow_retry=allow_retry)
    return run_stream(rows.filter(F.col("outcome") == APPENDED).drop("outcome"), path, checkpoint)


def decide_stream(events: DataFrame, path: str, checkpoint: str, *key: str, allow_retry: bool = True) -> StreamingQuery:
    """The same with refused events beside the others: a folder of ``path`` for each ``outcome``."""
    return run_stream(decided(events, *key, allow_retry=allow_retry), path, checkpoint, "outcome")


def replayed(events: DataFrame, *key: str, allow_retry: bool = True) -> DataFrame:
    """What the stream makes of a whole table at once: ``attempt`` and ``outcome`` by windows, given valid statuses and no supplied attempts.

    A key's events lie in one task here; the stream is the form for long ones.
    """
    w = W.partitionBy(*key).orderBy("seq")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("status") == "completed").over(earlier), F.lit(False))
    number = F.row_number().over(w)
    late = F.lit(False) if allow_retry else number > 1
    outcome = F.when(done, COMPLETED).when(late, NO_RETRY).otherwise(APPENDED)
    return events.withColumn("attempt", F.when(outcome == APPENDED, number).cast("int")).withColumn("outcome", outcome)
