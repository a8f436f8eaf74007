"""Places of lines in their files, and hash chains over files, on executors alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.ranks import range_rank
from ledgerline.sources.scratch import fresh, staged

MANIFEST = """status string, records long, index struct<path: string, sha256: string, rows: long>,
token_files array<struct<task: string, path: string, sha256: string, rows: long>>"""


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with ``file``, ``line`` (from 0 in its file) and ``place`` (from 0 over all files in order of their names).

    Files are read in splits, and only a split knows the order of its lines.
    So lines are written once with their split and their place in the task
    that read it; a line's number is that place and the lines of earlier splits,
    whose counts alone are summed. Nothing is sorted, and a file of any size is read by many tasks. Blank lines count.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split")]
    lines = staged(spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("_at")), fresh(spark, "lines"))
    splits = lines.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("file").agg(F.sum("_n").alias("_n")).select("file", earlier(W.partitionBy(F.lit(0)).orderBy("file")).alias("_files"))  # one row a file
    bases = splits.withColumn("_base", earlier(W.partitionBy("file").orderBy("_split"))).join(files, "file")  # one row a split
    line = F.col("_at") - F.col("_first") + F.col("_base")
    return lines.join(bases.drop("_n"), ["file", "_split"]).select("value", "file", line.alias("line"), (line + F.col("_files")).alias("place"))


def placed_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with ``file``, ``line`` and ``place``; without a schema it is found by a pass of its own. A line that is no record raises."""
    fields = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.json(path).schema)
    parsed = F.from_json("value", fields + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = placed_lines(spark, path).withColumn("_r", parsed)
    wrong = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | (F.trim("value") == "")
    message = F.concat(F.lit("no record in line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    rows = rows.withColumn("_r", F.when(wrong, F.raise_error(message)).otherwise(F.col("_r")))
    return rows.select("_r.*", "file", "line", "place").drop("_bad")


def sample_steps(rows: DataFrame, n: int, place: str, *by: str) -> DataFrame:
    """Every max(1, count // n)-th row of each task in order of a number (``place``), at most n, as a reader that walks the file takes them."""
    ranked = range_rank(rows, list(by), F.col(place), name="_k")
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / n))
    k = F.col("_k") - 1
    return ranked.filter((k % step == 0) & (F.floor(k / step) < n)).drop("_k", "_all")


def last_lines(rows: DataFrame, place: str, *by: str) -> DataFrame:
    """Of each key the record that comes last in its file, as a reader that overwrites earlier ones keeps it; aggregated before the shuffle."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in by)), F.struct(place)).alias("_r")).select(*by, "_r.*")


def qualified(spark: SparkSession, folder: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` (below the folder), ``bytes`` and ``sha256`` of every file, each hashed by the task that reads it; a file has to fit a task, and 2 GB. Spark does not list files of no bytes, so one that was emptied is missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.expr(f"substring(path, {len(qualified(spark, folder)) + 2})")
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def hash_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(``rule``, ``name``) of files that are ``missing``, ``unexpected``, ``changed`` or listed with two hashes (``ambiguous``); ``expected``: ``name``, ``sha256``."""
    listed = expected.groupBy("name").agg(F.min("sha256").alias("_sha"), (F.min("sha256") != F.max("sha256")).alias("_two"), F.lit(True).alias("_listed"))
    both = found.select("name", "sha256").join(listed, "name", "full")
    rule = F.when(F.col("_listed").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("_two"), "ambiguous").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "changed")
    return both.select(rule.alias("rule"), "name").filter("rule is not null")


def outside(path: Column) -> Column:
    """Whether a listed path leaves its folder."""
    return F.coalesce(F.startswith(path, F.lit("/")) | F.contains(path, F.lit(":")) | F.array_contains(F.split(path, "/"), ".."), F.lit(True))


def prepared_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What breaks the chain of a prepared artifact, as (``rule``, ``name``); none if it is whole.

    ``status.json`` names the hash of ``manifest.json``, which names index
    and token files with theirs. Both must say complete, nothing may
    lie beside what is listed, listed paths stay in the folder, the index has as many rows as it and the
    manifest say, and each of its rows names its task's token file.
    """
    base = folder.rstrip("/")
    document = lambda name, schema: spark.read.schema(schema).option("multiLine", "true").json(f"{base}/{name}")
    status, manifest = document("status.json", "status string, manifest_sha256 string"), document("manifest.json", MANIFEST)
    tokens = manifest.select(F.explode("token_files").alias("t")).select("t.*")
    listed = manifest.select(F.col("index.path").alias("name"), F.col("index.sha256").alias("sha256")).unionByName(tokens.select(F.col("path").alias("name"), "sha256"))
    expected = listed.unionByName(status.select(F.lit("manifest.json").alias("name"), F.col("manifest_sha256").alias("sha256")))
    files = hash_differences(file_hashes(spark, folder).filter("name != 'status.json'"), expected)
    state = status.select("status", F.lit("status.json").alias("name")).unionByName(manifest.select("status", F.lit("manifest.json").alias("name")))
    open_ = state.filter("not (status <=> 'complete')").select(F.lit("not complete").alias("rule"), "name")
    away = listed.filter(outside(F.col("name"))).select(F.lit("outside the folder").alias("rule"), "name")
    where = manifest.select("index.path").first()
    index = spark.read.schema("task string, token_file string").json(f"{base}/{where.path}") if where and where.path and ":" not in where.path and ".." not in where.path.split("/") else spark.createDataFrame([], "task string, token_file string")
    rows = index.agg(F.count("*").alias("n")).crossJoin(manifest.select("records", F.col("index.rows").alias("declared")))  # one row each
    counts = rows.filter("not (n <=> records and n <=> declared)").select(F.lit("row count").alias("rule"), F.lit(where.path if where else None).alias("name"))
    # a task has one token file; a task's rows are counted before the join
    used = index.groupBy("task", "token_file").agg(F.count("*").alias("n")).join(tokens.groupBy("task").agg(F.collect_set("path").alias("paths"), F.max("rows").alias("rows")), "task", "full")
    wrong = used.filter("not (size(paths) <=> 1 and token_file <=> paths[0] and n <=> rows)").select(F.lit("token file of a task").alias("rule"), F.coalesce("token_file", F.get("paths", F.lit(0)), "task").alias("name"))
    return files.unionByName(open_).unionByName(away).unionByName(counts).unionByName(wrong)
