"""Rollups of quality and compression, violation rates, counts and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType

from ledgerline.operators.ranks import quantiles, range_rank, same


def harmonic(x: str | Column) -> Column:
    """Harmonic mean; a value of zero and below raises, an empty group is null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.min(x) <= 0, F.raise_error(F.lit("harmonic mean of a value that is not positive"))).otherwise(F.try_divide(F.count(x), F.sum(F.try_divide(F.lit(1.0), x))))


def quality_rollup(rows: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Per group: ``micro`` mean, ``macro`` (mean of categories of means of tasks), ``n``. One shuffle of the rows."""
    task = rows.groupBy(*by, "category", "task").agg(F.sum(score).alias("s"), F.count(score).alias("n"))
    category = task.groupBy(*by, "category").agg(F.avg(F.col("s") / F.col("n")).alias("q"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return category.groupBy(*by).agg(F.avg("q").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"), F.sum("n").alias("n"))


def compression_rollup(rows: DataFrame, *by: str, ratio: str = "compression") -> DataFrame:
    """Per group: ``harmonic`` over rows, ``category_balanced`` (mean of categories of task harmonics)."""
    task = rows.groupBy(*by, "category", "task").agg(F.sum(F.try_divide(F.lit(1.0), F.col(ratio))).alias("inv"), F.count(ratio).alias("n"), F.min(ratio).alias("low"))
    safe = F.when(F.col("low") <= 0, F.raise_error(F.lit("ratios must be positive"))).otherwise(F.try_divide("n", "inv"))
    category = task.groupBy(*by, "category").agg(F.avg(safe).alias("c"), F.sum("inv").alias("inv"), F.sum("n").alias("n"))
    return category.groupBy(*by).agg(F.try_divide(F.sum("n"), F.sum("inv")).alias("harmonic"), F.avg("c").alias("category_balanced"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Quality and compression rollups side by side."""
    return quality_rollup(rows, *by).join(compression_rollup(rows, *by), list(by)) if by else quality_rollup(rows).crossJoin(compression_rollup(rows))  # one row each


def bases(rows: DataFrame, *by: str) -> DataFrame:
    """The three compression bases by name: ratio of mean bytes, ratio of summed bytes, harmonic mean of ratios."""
    return rows.groupBy(*by).agg((F.avg("kv_bytes_fp16") / F.avg("kv_bytes")).alias("ratio_of_means"), (F.sum("kv_bytes_fp16") / F.sum("kv_bytes")).alias("ratio_of_sums"), harmonic("compression").alias("harmonic"))


def task_report(rows: DataFrame, digits: tuple[int, int] = (4, 3)) -> DataFrame:
    """First-generation report: per task the rounded mean score, rounded harmonic ratio and count."""
    return rows.groupBy("task").agg(F.round(F.avg("score"), digits[0]).alias("q"), F.round(harmonic("compression"), digits[1]).alias("cr"), F.count("*").alias("n"))


def picks_report(chosen: DataFrame, configurations: list[str], digits: tuple[int, int] = (4, 3)) -> DataFrame:
    """Per task, and over all items as ``overall``: rounded mean score and harmonic ratio, count, and how often each configuration was chosen."""
    picks = [F.count_if(F.col("configuration") == c).alias(f"picks_{c}") for c in configurations]
    rows = chosen.rollup("task").agg(F.grouping("task").alias("_all"), F.round(F.avg("score"), digits[0]).alias("q"), F.round(harmonic("compression"), digits[1]).alias("cr"), F.count("*").alias("n"), *picks)
    return rows.withColumn("task", F.when(F.col("_all") == 1, "overall").otherwise(F.col("task"))).drop("_all")


def fixed_configurations(rows: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Mean score and harmonic ratio of always choosing one configuration, on all items or a subset of keys; ratios of zero stay out."""
    rows = rows if subset is None else rows.join(subset.select("key").distinct(), "key", "left_semi")
    return rows.groupBy("configuration").agg(F.avg("score").alias("q"), harmonic(F.when(F.col("compression") > 0, F.col("compression"))).alias("cr"), F.count("*").alias("n"))


def selection_counts(chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each task chose each configuration, zeros filled in."""
    tasks, configurations = chosen.select("task").distinct(), labels.select("configuration").distinct()
    counts = chosen.groupBy("task", "configuration").agg(F.count("*").alias("n"))
    return tasks.crossJoin(F.broadcast(configurations)).join(counts, ["task", "configuration"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))  # both sides are registry-sized


def violations(chosen: DataFrame, baseline: DataFrame, tau: float) -> DataFrame:
    """Share of selected rows below tau times the baseline's score, below the baseline, and the mean difference."""
    base = baseline.select("key", F.col("score").alias("base"))
    both = chosen.select("key", "score").join(base, "key")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("score") < tau * F.col("base")).cast("double")).alias("below_tau"), F.avg((F.col("score") < F.col("base")).cast("double")).alias("below_base"), F.avg(F.col("score") - F.col("base")).alias("mean_delta"))


def length_profile(rows: DataFrame, length: str, cap: int, *by: str) -> DataFrame:
    """Exact linear percentiles, largest, truncated rows and the share of length kept under a cap."""
    x = F.col(length)
    totals = rows.groupBy(*by).agg(F.max(x).alias("longest"), F.sum((x > cap).cast("long")).alias("truncated"), (F.sum(F.least(x, F.lit(cap))) / F.sum(x)).alias("retained"))
    found = quantiles(rows, list(by), length, {f"p{p}": p / 100 for p in (50, 90, 95, 99)})
    return same(totals, found, list(by), "left").select(*by, "p50", "p90", "p95", "p99", "longest", "truncated", "retained")


def truncation_differences(rows: DataFrame, length: str, cap: int, expected: DataFrame) -> DataFrame:
    """Tasks whose number of rows longer than ``cap`` is not that of ``expected`` (``task``, ``truncated``), tasks of one side only among them."""
    counted = rows.groupBy("task").agg(F.count_if(F.col(length) > cap).alias("found"))
    return counted.join(expected, "task", "full").filter(~F.col("found").eqNullSafe(F.col("truncated")))


def fit_metrics(rows: DataFrame, *by: str, y: str = "score", p: str = "prediction") -> DataFrame:
    """Mean absolute error and R2; constant truth gives 1 if met exactly, else 0; a single row gives null."""
    n, mean = F.count("*"), F.avg(y)
    res = F.sum(F.pow(F.col(y) - F.col(p), 2))
    tot = F.sum(F.pow(F.col(y), 2)) - n * mean * mean
    r2 = F.when(n < 2, None).when(F.min(y) == F.max(y), F.when(res == 0, 1.0).otherwise(0.0)).otherwise(1 - res / tot)
    return rows.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), r2.alias("r2"), n.alias("n"))


def decomposition(chosen: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per task: chosen and baseline quality, their difference, and its contribution to the overall difference."""
    both = chosen.select("key", "task", "score").join(baseline.select("key", F.col("score").alias("base")), "key")
    per = both.groupBy("task").agg(F.avg("score").alias("q"), F.avg("base").alias("base_q"), F.sum(F.col("score") - F.col("base")).alias("d"), F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # one row a task
    return per.select("task", "q", "base_q", (F.col("q") - F.col("base_q")).alias("delta"), (F.col("d") / total).alias("contribution"), "n")


def noise(rows: DataFrame) -> DataFrame:
    """Per configuration: shares of items above, tied with and below the baseline; mean of the largest difference of an item."""
    base = F.max(F.when(F.col("cfg_ord") == 0, F.col("score"))).over(W.partitionBy("key"))
    most = F.max(F.when(F.col("cfg_ord") > 0, F.abs(F.col("score") - F.col("base")))).over(W.partitionBy("key"))
    diff = rows.withColumn("base", base).withColumn("most", most).filter("cfg_ord > 0")
    return diff.groupBy("configuration").agg(F.avg((F.col("score") > F.col("base")).cast("double")).alias("above"), F.avg((F.col("score") == F.col("base")).cast("double")).alias("tie"), F.avg((F.col("score") < F.col("base")).cast("double")).alias("below"), F.avg("most").alias("mean_max_diff"))


def metric_beats(rows: DataFrame, metric: str) -> DataFrame:
    """Per ``metric`` how many items it has, and for how many (and which share) some candidate's score is above the baseline's."""
    score = lambda when: F.max(F.when(when, F.col("score")))
    per = rows.groupBy(metric, "key").agg(score(F.col("cfg_ord") > 0).alias("_best"), score(F.col("cfg_ord") == 0).alias("_base"))
    beats = F.coalesce(F.col("_best") > F.col("_base"), F.lit(False))
    return per.groupBy(metric).agg(F.count_if(beats).alias("beats"), F.count("*").alias("items"), F.avg(beats.cast("double")).alias("share"))


def run_averages(rows: DataFrame, *by: str, digits: tuple[int, int] = (4, 3)) -> DataFrame:
    """First-generation averages of a run: the mean of its tasks' rounded mean scores, and the mean of items' ratios, rounded."""
    tasks = rows.groupBy(*by, "task").agg(F.round(F.avg("score"), digits[0]).alias("_q"), F.sum("compression").alias("_c"), F.count("*").alias("_n"))
    return tasks.groupBy(*by).agg(F.round(F.avg("_q"), digits[0]).alias("q"), F.round(F.sum("_c") / F.sum("_n"), digits[1]).alias("ratio"), F.count("*").alias("tasks"))


def latency(rows: DataFrame, ms: str, order: str, warmup: int, *by: str) -> DataFrame:
    """Median and 95th percentile after the first ``warmup`` rows of each group by ``order`` (then by ``ms``), and how many rows these are.

    Numbers and times are ranked by ranges, so no group is sorted in one task;
    other orders by a window over the group.
    """
    kind = rows.schema[order].dataType
    if isinstance(kind, NumericType | TimestampType):
        ranked = range_rank(rows, list(by), F.col(order), ms, name="_r")
    else:
        ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order, ms)))
    kept = ranked.filter(F.col("_r") > warmup).select(*by, ms, order)
    counts = kept.groupBy(*by).agg(F.count("*").alias("n"))
    return same(counts, quantiles(kept, list(by), ms, {"median": 0.5, "p95": 0.95}, order if isinstance(kind, NumericType) else None), list(by), "left").select(*by, "median", "p95", "n")


def value_report(rows: DataFrame, *by: str) -> DataFrame:
    """Smallest, largest and mean score and ratio of the labels."""
    return rows.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in ("score", "compression") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def ordered_digest(rows: DataFrame, by: str, order: list[str], line: Column) -> DataFrame:
    """Order-sensitive sha256 over the lines of each group; a group's lines are brought together, so groups must be bounded."""
    items = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(items, lambda x: x["line"]), ""), 256).alias("digest"), F.count("*").alias("n"))


def ordered_ids_sha256(rows: DataFrame, by: str, id_col: str, order: list[str]) -> DataFrame:
    """Per group the sha256 over its ids in order, each behind its length in bytes as eight bytes, little end first. A group's ids are brought together, so groups must be bounded."""
    data = F.encode(F.col(id_col), "UTF-8")
    n = F.octet_length(F.col(id_col)).cast("long")
    length = F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)))
    framed = F.sort_array(F.collect_list(F.struct(*order, F.concat(length, F.hex(data)).alias("_x"))))
    return rows.groupBy(by).agg(F.sha2(F.unhex(F.array_join(F.transform(framed, lambda x: x["_x"]), "")), 256).alias("digest"), F.count("*").alias("n"))
