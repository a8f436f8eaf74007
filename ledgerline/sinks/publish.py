"""Runs that are created once, and tables published in them with what proves them whole, on any store Spark writes to.

A published table is a folder: ``data`` (Parquet), ``files`` (name, bytes and
sha256 of every data file, hashed by the tasks that read them) and ``record``
(rows, schema, and two sums of row hashes). The record is written last, so a
folder without one is a table that was cut off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.validate import require_none
from ledgerline.sinks.export import COMPONENT
from ledgerline.sources.files import file_hashes, hash_differences
from ledgerline.sources.scratch import exists

MARK = "_RUN"


def run_path(root: str, model: str, run: str) -> str:
    """``<root>/<model>/<run>``; model and run must be plain names."""
    for part in (model, run):
        if not COMPONENT.fullmatch(part):
            raise ValueError(f"not a plain name: {part}")
    return f"{root.rstrip('/')}/{model}/{run}"


def create_run(spark: SparkSession, root: str, model: str, run: str) -> str:
    """The path of a new run; raises if there is one of that name. Of two that create it at once, one gets it: its mark is a file that is created if absent."""
    path = run_path(root, model, run)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}")
    store = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(mark.getParent()):
        raise FileExistsError(f"the run exists: {path}")
    store.mkdirs(mark.getParent())
    try:
        store.create(mark, False).close()
    except Exception as e:  # another process was first
        if store.exists(mark):
            raise FileExistsError(f"the run exists: {path}") from e
        raise
    return path


def open_run(spark: SparkSession, root: str, model: str, run: str) -> str:
    """The path of a run that was created; makes and changes nothing."""
    path = run_path(root, model, run)
    if not exists(spark, f"{path}/{MARK}"):
        raise FileNotFoundError(path)
    return path


def _record(rows: DataFrame) -> DataFrame:
    names = sorted(rows.columns)
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(name) for seed, name in ((1, "x"), (2, "y"))]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.agg(F.count("*").alias("rows"), *sums).withColumn("schema", F.lit(schema))


def publish(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a table where none is, with its record, and give it back as read. Columns are of any type but maps, whose rows have no hash.

    What is recorded is what lies there: rows are counted and hashed from the written files.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    if exists(spark, base):
        raise FileExistsError(f"a table is there: {base}")
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{base}/data")
    rows = spark.read.schema(df.schema).parquet(f"{base}/data")
    file_hashes(spark, f"{base}/data").write.mode("errorifexists").parquet(f"{base}/files")
    _record(rows).coalesce(1).write.mode("errorifexists").json(f"{base}/record")  # one row
    return rows


def _file_violations(spark: SparkSession, base: str) -> DataFrame:
    if not exists(spark, f"{base}/record/_SUCCESS"):
        return spark.createDataFrame([("not complete", base)], "rule string, name string")
    return hash_differences(file_hashes(spark, f"{base}/data"), spark.read.parquet(f"{base}/files"))


def _record_violations(spark: SparkSession, base: str, schema) -> DataFrame:
    kept = spark.read.schema("rows long, x string, y string, schema string").json(f"{base}/record")
    found = _record(spark.read.schema(schema).parquet(f"{base}/data"))
    pairs = kept.select(F.struct("rows", "x", "y", "schema").alias("k")).crossJoin(found.select(F.struct("rows", "x", "y", "schema").alias("f")))  # one row each
    rules = F.array(F.when(F.expr("k.rows != f.rows"), "rows"), F.when(F.expr("k.schema != f.schema"), "schema"), F.when(F.expr("k.x != f.x or k.y != f.y"), "content"))
    return pairs.select(F.explode(F.array_compact(rules)).alias("rule"), F.lit("record").alias("name"))


def published_violations(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a published table is not, as (``rule``, ``name``): files that are missing, unexpected or changed, and a record of other rows or columns."""
    base = path.rstrip("/")
    files = _file_violations(spark, base)
    return files if not exists(spark, f"{base}/record/_SUCCESS") else files.unionByName(_record_violations(spark, base, schema))


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    """A published table, if it is whole; what is not is named. Files are compared before rows are read, so a damaged file is named too."""
    base = path.rstrip("/")
    require_none(_file_violations(spark, base), f"{base}: files")
    require_none(_record_violations(spark, base, schema), f"{base}: rows")
    return spark.read.schema(schema).parquet(f"{base}/data")
