"""Readers of task files, journals, prepared indexes and results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerline.sources.files import MANIFEST, placed_json, prepared_violations, sample_steps

EXAMPLE = "_id string, input string, context string, answers array<string>, all_classes array<string>, dataset string, language string, length long"
EVENT = "model string, configuration string, task string, benchmark_id string, status string, attempt int, score double, kv_bytes double, kv_bytes_fp16 double, prediction string"


def sample_task(rows: DataFrame, n: int, order: str, *by: str) -> DataFrame:
    """Every max(1, count // n)-th row of each task in order, at most n. Numbers (a place in the file) are ranked by ranges, other orders by a window."""
    if isinstance(rows.schema[order].dataType, NumericType):
        return sample_steps(rows, n, order, *by)
    w = W.partitionBy(*by)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n))
    k = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("_k", k).withColumn("_s", step).filter("_k % _s = 0 and _k div _s < " + str(n)).drop("_k", "_s")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a blank, partial or non-object line raises, and a file whose last line has no line feed."""
    if cut := cut_files(spark, path):
        raise ValueError(f"the last line of {cut[0]} has no line feed")
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    ok = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).when(F.col("r._bad").isNotNull() | F.col("r").isNull(), F.raise_error(F.concat(F.lit("no valid record: "), F.substring("value", 1, 80)))).otherwise(F.col("r"))
    return parsed.select(ok.alias("r")).select("r.*").drop("_bad")


def cut_files(spark: SparkSession, path: str) -> list[str]:
    """The files at a path of any store that are not empty and do not end with a line feed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    store, out = where.getFileSystem(conf), []
    for f in store.globStatus(where) or []:
        for part in store.listStatus(f.getPath()) if f.isDirectory() else [f]:
            if part.getLen() and not part.getPath().getName().startswith(("_", ".")):
                stream = store.open(part.getPath())
                stream.seek(part.getLen() - 1)
                if stream.read() != 10:
                    out.append(part.getPath().toString())
                stream.close()
    return out


def read_routing(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """First-generation routing dataset: JSON lines of items with ``scores`` and ``compression`` per configuration, in the labels' long form.

    ``path`` may hold ``{model}``. Items without a ``sample_idx`` get their line's number in its file.
    """
    path = path.format(model=model) if model else path
    rows = spark.read.json(path)
    return long_labels(rows if "sample_idx" in rows.columns else placed_json(spark, path).withColumnRenamed("line", "sample_idx").drop("file", "place"))


def long_labels(rows: DataFrame) -> DataFrame:
    """Wide items (structs ``scores``, ``compression`` by configuration) as one row per configuration."""
    names = sorted(rows.schema["scores"].dataType.fieldNames())
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("configuration"), F.lit(i).alias("cfg_ord"), F.col(f"scores.{c}").cast("double").alias("score"), F.col(f"compression.{c}").cast("double").alias("compression")) for i, c in enumerate(names))))
    return rows.select("task", F.concat_ws(":", "task", F.col("sample_idx").cast("string")).alias("key"), each.alias("_c")).select("task", "key", "_c.*")


def complete_file(path: str) -> bool:
    """Whether a local file ends with a line feed."""
    with open(path, "rb") as f:
        f.seek(0, 2)
        if not f.tell():
            return True
        f.seek(-1, 2)
        return f.read(1) == b"\n"


def load_task(spark: SparkSession, path: str, dataset: str, language: str, count: int, sha256: str | None = None) -> DataFrame:
    """A task file whose hash, fields, dataset, language, count and ids are as the registry says."""
    if sha256:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256")).collect()  # one file
        if [r.sha256 for r in found] != [sha256]:
            raise ValueError(f"{path} is not the registered file")
    rows = read_json_lines(spark, path, EXAMPLE)
    bad = rows.select(F.count("*").alias("n"), F.countDistinct("_id").alias("ids"), F.count_if((F.col("dataset") != dataset) | (F.col("language") != language) | (F.coalesce(F.size("answers"), F.lit(0)) < 1) | (F.col("length") < 0) | F.col("_id").isNull() | F.col("context").isNull() | F.col("input").isNull()).alias("bad")).first()
    if (bad.n, bad.ids, bad.bad) != (count, count, 0):
        raise ValueError(f"{path}: {bad.n} rows, {bad.ids} ids, {bad.bad} invalid; {count} expected")
    return rows


def read_logs(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """First-generation logs by configuration; (their union, configurations without a file)."""
    out, gone = None, []
    for configuration, path in paths.items():
        if not Path(path).exists():
            gone.append(configuration)
            continue
        rows = spark.read.json(path).withColumn("configuration", F.lit(configuration))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, gone


def read_results(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Results documents; the first of ``keys`` that is there becomes ``ratio``."""
    rows = spark.read.option("multiLine", True).json(path)
    there = [F.col(k).cast("double") for k in keys if k in rows.columns]
    return rows.withColumn("ratio", F.coalesce(*there) if there else F.lit(None).cast("double"))


def locked(path: str, expected: dict) -> dict:
    """A configuration document that must equal what is expected."""
    found = json.loads(Path(path).read_text())
    if found != expected:
        differing = sorted(k for k in found.keys() | expected.keys() if found.get(k) != expected.get(k))
        raise ValueError(f"{path} drifted in {', '.join(differing)}")
    return found


def registry(spark: SparkSession, tasks: list[dict], excluded: int = 0) -> DataFrame:
    """The task dimension, checked: unique names, positive counts, known scorers; in canonical order by ``task_ord``."""
    scorers = {"qa_f1", "rouge_l", "classification", "count", "retrieval", "code_similarity"}
    names = [t["task"] for t in tasks]
    if len(set(names)) != len(names) or any(t["expected"] <= 0 or t["max_new_tokens"] <= 0 or t["scorer"] not in scorers for t in tasks) or excluded < 0:
        raise ValueError("invalid task registry")
    rows = [(i, t["task"], t["category"], t["expected"], t["scorer"], t["max_new_tokens"]) for i, t in enumerate(tasks)]
    return spark.createDataFrame(rows, "task_ord int, task string, category string, expected long, scorer string, max_new_tokens int")


def read_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """A prepared index behind its hash chain: status, manifest, index and every token file; what breaks it is named."""
    from ledgerline.operators.validate import require_none

    require_none(prepared_violations(spark, folder), f"{folder}: the hash chain is broken")
    where = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{folder.rstrip('/')}/manifest.json").select("index.path").first()
    return spark.read.json(f"{folder.rstrip('/')}/{where.path}")


def check_tokens(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """Index rows whose stored ids differ in number or hash."""
    from ledgerline.functions.features import ids_sha256

    found = tokens.select("task", "key", F.size("ids").alias("_n"), ids_sha256(F.col("ids")).alias("_sha"))
    return index.join(found, ["task", "key"], "left").filter(~F.coalesce((F.col("_n") == F.col("token_count")) & (F.col("_sha") == F.col("token_sha256")), F.lit(False)))


def repair_tail(path: str) -> int:
    """Bytes dropped from, or -1 for a line feed added to, a local journal whose last write was cut; earlier lines stay."""
    data = Path(path).read_bytes()
    if not data or data.endswith(b"\n"):
        return 0
    head, _, tail = data.rpartition(b"\n")
    try:
        if isinstance(json.loads(tail), dict):
            with open(path, "ab") as f:
                f.write(b"\n")
            return -1
    except ValueError:
        pass
    with open(path, "r+b") as f:
        f.truncate(len(data) - len(tail))
    return len(tail)
