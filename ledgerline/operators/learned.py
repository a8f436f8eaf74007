"""Learned score predictions: boosted trees per (held-out fold, configuration).

Every fit is a distributed one: trees grow on histograms that tasks sum and
the driver only chooses splits from, so a fold or configuration may be of any
size. All fits grow together (``boosting``). Predictions are a table, made once
for given scores, features, folds and settings, and found again by their content.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import boosting
from ledgerline.sources.scratch import exists, fresh, shared, staged

PREDICTIONS = "key {key}, fold {fold}, cfg_ord int, prediction double"


@dataclass(frozen=True)
class Settings:
    """The published learner's by default; ``features`` names those of the vector that are looked at (none: all)."""

    rounds: int = 300
    depth: int = 4
    rate: float = 0.05
    bins: int = 255
    least: int = 20
    seed: int = 42
    features: tuple[str, ...] = ()


def items(labels: DataFrame, features: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per item: ``key``, ``fold``, ``s<cfg_ord>`` (score) per configuration, and the columns of ``features`` with null as -1."""
    ordinals = sorted(r[0] for r in labels.select("cfg_ord").distinct().collect())  # one row a configuration
    scores = labels.groupBy("key").agg(*(F.max(F.when(F.col("cfg_ord") == c, F.col("score"))).alias(f"s{c}") for c in ordinals))
    filled = features.select("key", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features.columns if c != "key"))
    return scores.join(folds.select("key", "fold"), "key").join(filled, "key")


def learner(names: list[str], label: str, out: str, s: Settings) -> Pipeline:
    """One fit by spark.ml, for a table of its own; as 60 fits of 300 rounds it would be some 70,000 jobs."""
    gather = VectorAssembler(inputCols=names, outputCol="_x")
    scale = StandardScaler(inputCol="_x", outputCol="_z", withMean=True)
    trees = GBTRegressor(featuresCol="_z", labelCol=label, predictionCol=out, maxIter=s.rounds, maxDepth=s.depth, stepSize=s.rate, maxBins=s.bins, minInstancesPerNode=s.least, seed=s.seed)
    return Pipeline(stages=[gather, scale, trees])


def predictions(rows: DataFrame, s: Settings | None = None) -> DataFrame:
    """``key``, ``fold``, ``cfg_ord``, ``prediction`` of ``items`` rows, each by fits that have not seen its fold.

    Folds are a few (each is a fit per configuration), so they are listed on
    the driver. An empty table gives no predictions, and so does a table of a
    single fold, whose fits would have no rows. A fit without scores predicts null.
    """
    s = s or Settings()
    names = [c for c in rows.columns if c not in ("key", "fold") and not (c[0] == "s" and c[1:].isdigit())]
    names = [c for c in names if c in s.features] if s.features else names
    ordinals = sorted(int(c[1:]) for c in rows.columns if c[0] == "s" and c[1:].isdigit())
    folds = sorted((r[0] for r in rows.select("fold").distinct().collect()), key=lambda x: (x is None, x))  # a fold a row
    empty = rows.sparkSession.createDataFrame([], PREDICTIONS.format(key=rows.schema["key"].dataType.simpleString(), fold=rows.schema["fold"].dataType.simpleString()))
    if len(folds) < 2 or not ordinals:
        return empty
    place = F.coalesce(*(F.when(F.col("fold").eqNullSafe(F.lit(f)), F.lit(k)) for k, f in enumerate(folds)))
    placed = rows.withColumn("_fold", place)
    cuts, base, trees = boosting.boost(placed, names, [f"s{c}" for c in ordinals], len(folds), s)
    found = placed.select("key", "_fold", *names).mapInPandas(
        partial(boosting.predict, names=names, cuts=cuts, base=base, trees=trees, depth=s.depth), f"key {rows.schema['key'].dataType.simpleString()}, _fold int, p array<double>"
    )
    named = rows.sparkSession.createDataFrame(list(enumerate(folds)), f"_fold int, fold {rows.schema['fold'].dataType.simpleString()}")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cfg_ord"), F.nanvl(F.col("p")[i], F.lit(None)).alias("prediction")) for i, c in enumerate(ordinals)))).alias("_c")
    return found.join(F.broadcast(named), "_fold").select("key", "fold", each).select("key", "fold", "_c.cfg_ord", "_c.prediction")  # a fold a row


def fingerprint(rows: DataFrame) -> str:
    """Of a table's rows in any order, repeated ones counted, and of its columns: by sums of two hashes, in one aggregation."""
    names = sorted(rows.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")) for seed in (1, 2)]
    found = rows.agg(F.count("*"), *sums).first()
    return hashlib.sha256(json.dumps([names, [rows.schema[c].dataType.simpleString() for c in names], [str(x) for x in found]]).encode()).hexdigest()


def address(rows: DataFrame, s: Settings) -> str:
    """What predictions depend on: scores, features and folds (``items`` rows), and the settings."""
    return hashlib.sha256(json.dumps([fingerprint(rows), asdict(s)], sort_keys=True).encode()).hexdigest()


def stored_predictions(rows: DataFrame, s: Settings | None = None, store: str | None = None) -> DataFrame:
    """The predictions of ``items`` rows from ``store`` (by default in the shared folder), made and stored there if they are not yet.

    A table's name is the hash of all it depends on, so another score, feature,
    fold or setting is another table and a stale one is never read. Spark's
    committer makes a table appear as a whole; one without its mark of success is made again.
    """
    spark, s = rows.sparkSession, s or Settings()
    path = f"{store or shared(spark) + '/ledgerline/predictions'}/{address(rows, s)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        kept = staged(rows, fresh(spark, "items"))
        parts = max(1, min(spark.sparkContext.defaultParallelism, kept.count() // boosting.BLOCK))
        # read several times: dealt out once, not by each reading, and in order, as sums depend on it in their last digits
        dealt = staged(kept.repartition(parts, "key").sortWithinPartitions("key"), fresh(spark, "dealt"))
        predictions(dealt, s).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def require_fresh(stored_path: str, rows: DataFrame, s: Settings) -> None:
    """Raises if predictions at a path that was written down before are not of these rows and settings."""
    if stored_path.rstrip("/").rpartition("/")[2] != address(rows, s):
        raise ValueError(f"{stored_path} holds predictions of other scores, features, folds or settings")


def mean_baseline(rows: DataFrame) -> DataFrame:
    """``fold``, ``cfg_ord``, ``mean``: a configuration's mean score over the other folds."""
    ordinals = [c for c in rows.columns if c[0] == "s" and c[1:].isdigit()]
    long = rows.select("fold", F.explode(F.array(*(F.struct(F.lit(int(c[1:])).alias("cfg_ord"), F.col(c).alias("score")) for c in ordinals))).alias("_c")).select("fold", "_c.*")
    per = long.groupBy("fold", "cfg_ord").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    total = per.groupBy("cfg_ord").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    return per.join(total, "cfg_ord").select("fold", "cfg_ord", ((F.col("_s") - F.col("s")) / (F.col("_n") - F.col("n"))).alias("mean"), (F.col("_n") - F.col("n")).alias("train_rows"))


def fit_report(labels: DataFrame, rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per fold and configuration: ``train_rows``, ``test_rows``, ``mae``, ``r2`` and ``mean_mae``, the error of the other folds' mean."""
    both = labels.select("key", "cfg_ord", "configuration", "score").join(predicted, ["key", "cfg_ord"]).join(F.broadcast(mean_baseline(rows)), ["fold", "cfg_ord"])  # one row a fold and configuration
    error = F.col("score") - F.col("prediction")
    var = F.sum(F.col("score") * F.col("score")) - F.count("*") * F.avg("score") * F.avg("score")
    return both.groupBy("fold", "configuration").agg(
        F.max("train_rows").alias("train_rows"), F.count("*").alias("test_rows"), F.avg(F.abs(error)).alias("mae"),
        F.when(var > 0, 1 - F.sum(error * error) / var).alias("r2"), F.avg(F.abs(F.col("score") - F.col("mean"))).alias("mean_mae"),
    )


def vector_features(text: Column, ids: Column) -> dict[str, Column]:
    """The seven prompt features, by name."""
    from ledgerline.functions.features import gzip_ratio, prompt_features

    return prompt_features(text, ids) | {"gzip_ratio": F.round(gzip_ratio(text), 4)}


#: Words that configurations C0 to C5 of the text panel keep.
CAPS = (None, 256, 128, 64, 32, 16)


def text_cells(w: Column, distinct: Column) -> Column:
    """Per configuration of a text's words: ``cfg_ord``, ``configuration``, ``score`` and ``compression``. Only texts over a cap are cut and counted again."""
    n = F.size(w)

    def cell(i: int, cap: int | None) -> Column:
        from ledgerline.functions.features import middle_truncate

        over = F.lit(False) if cap is None else n > cap
        kept = distinct if cap is None else F.when(over, F.size(F.array_distinct(middle_truncate(w, cap)))).otherwise(distinct)
        left = n if cap is None else F.when(over, F.lit(2 * (cap // 2))).otherwise(n)
        return F.struct(F.lit(i).alias("cfg_ord"), F.lit(f"C{i}").alias("configuration"), (kept / distinct).alias("score"), (n / left).alias("compression"))

    return F.array(*(cell(i, cap) for i, cap in enumerate(CAPS)))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key``, ``task``, ``cells`` and the seven features of every text that has words: one row and one pass a text."""
    from ledgerline.functions.features import words

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), F.concat_ws("-", "lang").alias("task"), F.coalesce("text", F.lit("")).alias("text"))
    some = docs.filter(F.col("text").rlike(r"(?U)\S")).withColumn("w", words(F.col("text")))  # a filter on the words would have texts split twice
    some = some.withColumn("_distinct", F.size(F.array_distinct("w")))
    return some.select("key", "task", text_cells(F.col("w"), F.col("_distinct")).alias("cells"), *(c.alias(n) for n, c in vector_features(F.col("text"), F.col("w")).items()))


def text_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels and features of texts under caps on their words: C0 keeps all, C1 to C5 the first and last 8 to 128.

    The score is the share of a text's distinct words that are kept, the ratio words over kept words.
    Both are read from one staged table of numbers, so texts are read once, however often labels and features are.
    """
    table = staged(text_table(spark, sf_dir), fresh(spark, "texts"))
    labels = table.select("task", F.col("task").alias("category"), "key", F.explode("cells").alias("c")).select("task", "category", "key", "c.configuration", "c.cfg_ord", "c.score", "c.compression")
    return labels, table.drop("task", "cells")


def cross_validated(spark: SparkSession, sf_dir: str, folds: int = 10, s: Settings | None = None, store: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labels, folds, ``items`` rows and stored predictions of the text panel: by default the published 10 folds and settings."""
    from ledgerline.operators.router import stratified_folds

    labels, features = text_panel(spark, sf_dir)
    fold = staged(stratified_folds(labels.filter("cfg_ord = 0"), folds), fresh(spark, "folds"))
    rows = staged(items(labels, features, fold), fresh(spark, "items"))
    return labels, fold, rows, stored_predictions(rows, s, store)
