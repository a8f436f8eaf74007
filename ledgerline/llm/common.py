"""Helpers shared by the pipeline operators: table loading and shared staging."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a temporary folder of this machine is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return _LOCAL_FALLBACK[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ledgerline/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The session with these settings, which are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor never recomputes what lies
    before, and gives the planner true sizes for what follows. Shuffle files
    of the step go once it is written. ``batch_rows``: rows of an Arrow batch.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    with settings(spark, conf):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
