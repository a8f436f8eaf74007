"""The journal as a stateful stream: its rules, restarts, replays, and what a batch costs."""

import json
import random
from pathlib import Path

import pytest

from ledgerline.streaming import journal as J

SCHEMA = "task string, item long, seq long, status string, attempt int, note string"


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(place, name, rows):
    names = ("task", "item", "seq", "status", "attempt", "note")
    (place / "in" / f"{name}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=False))) + "\n" for r in rows))


def run(spark, place, retry=True, files=1):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(str(place / "in"))
    q = J.decide_stream(events, str(place / "out"), str(place / "state"), "task", "item", allow_retry=retry)
    q.awaitTermination()
    return q


def rows(spark, place):
    return sorted((r.seq, r.attempt, r.outcome) for r in spark.read.parquet(str(place / "out")).collect())


def test_rules(spark, place):
    put(place, 0, [("qa", 0, 1, "completed", None, "kept"), ("story", 17, 2, "failed", None, "memory")])
    run(spark, place, retry=False)
    put(place, 1, [("qa", 0, 3, "completed"), ("story", 17, 4, "completed")])
    run(spark, place, retry=False)
    put(place, 2, [("story", 17, 6, "completed", 2), ("story", 17, 5, "failed", 7), ("music", 2, 7, "running"), (None, None, 8, "failed", 1), (None, None, 9, "completed"), ("story", 17, 10, None)])
    run(spark, place)
    assert rows(spark, place) == [
        (1, 1, "appended"), (2, 1, "appended"), (3, None, J.COMPLETED), (4, None, J.NO_RETRY), (5, None, J.BAD_ATTEMPT), (6, 2, "appended"),
        (7, None, J.BAD_STATUS), (8, 1, "appended"), (9, 2, "appended"), (10, None, J.BAD_STATUS),
    ]


def test_same_as_the_whole_table_and_as_one_batch(spark, tmp_path):
    rng = random.Random(4)
    events = [("t", rng.randrange(12), seq, rng.choice(["failed", "failed", "completed"])) for seq in range(300)]
    found = []
    for k, parts in enumerate((1, 3)):
        place = tmp_path / str(k)
        (place / "in").mkdir(parents=True)
        for p in range(parts):
            put(place, p, events[p * 300 // parts : (p + 1) * 300 // parts])
            run(spark, place)
        found.append(rows(spark, place))
    whole = J.replayed(spark.createDataFrame([e for e in events], "task string, item long, seq long, status string"), "task", "item")
    assert found[0] == found[1] == sorted((r.seq, r.attempt, r.outcome) for r in whole.collect())


def test_a_batch_run_again_appears_once(spark, place):
    for k in range(3):
        put(place, k, [("t", i, 10 * k + i, "failed" if k < 2 else "completed") for i in range(5)])
        run(spark, place)
    before = rows(spark, place)
    commits = sorted((p for p in Path(place / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver was lost after the sink's write and before the commit
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(spark, place)
    assert rows(spark, place) == before == [(10 * k + i, k + 1, "appended") for k in range(3) for i in range(5)]


def test_a_batch_costs_its_own_keys(spark, place):
    put(place, 0, [("t", i, i, "failed") for i in range(400)])
    run(spark, place)
    put(place, 1, [("t", 7, 1000, "completed")])
    q = run(spark, place)
    (state,) = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    assert (state["numRowsTotal"], state["numRowsUpdated"]) == (400, 1)
    assert sum(p["numInputRows"] for p in q.recentProgress) == 1
