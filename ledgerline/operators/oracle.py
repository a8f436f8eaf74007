"""Post-hoc oracles: the best configuration of each item in hindsight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_baseline(labels: DataFrame) -> DataFrame:
    """Adds the baseline's score of the item. The one shuffle by key serves the windows after it too."""
    return labels.withColumn("base", F.max(F.when(F.col("cfg_ord") == 0, F.col("score"))).over(W.partitionBy("key")))


def iso_quality(labels: DataFrame, tau: float = 0.99, include_baseline: bool = False) -> DataFrame:
    """The row of the largest ratio among candidates that keep ``tau`` of the baseline's score.

    Ties go to the earlier configuration. Where none is eligible, the best score
    wins (then ratio, then configuration) and ``fallback`` is true.
    ``eligible`` lists the eligible configurations in order.
    """
    rows = with_baseline(labels).withColumn("_ok", F.col("score") >= tau * F.col("base"))
    rows = rows if include_baseline else rows.filter("cfg_ord >= 1")
    item = W.partitionBy("key")
    rows = rows.withColumn("_any", F.max("_ok").over(item)).withColumn("eligible", F.sort_array(F.collect_list(F.when(F.col("_ok"), F.col("configuration"))).over(item)))
    order = [F.desc("_ok"), F.desc(F.when(F.col("_any"), F.lit(0.0)).otherwise(F.col("score"))), F.desc("compression"), "cfg_ord"]
    best = rows.withColumn("_r", F.row_number().over(item.orderBy(*order))).filter("_r = 1")
    return best.withColumn("fallback", ~F.col("_any")).drop("_ok", "_any", "_r")


def quality_first(labels: DataFrame, ties: str = "compression", include_baseline: bool = False) -> DataFrame:
    """The row of the best score; ties by ratio then configuration, or (``ties='order'``) by configuration alone."""
    rows = labels if include_baseline else labels.filter("cfg_ord >= 1")
    order = [F.desc("score"), *([F.desc("compression")] if ties == "compression" else []), "cfg_ord"]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter("_r = 1").drop("_r")


def gathered(labels: DataFrame, *fields: str) -> DataFrame:
    """One row per item: ``key``, ``task``, the baseline's score ``base`` and its configurations ``c`` in order. The only shuffle of what follows."""
    c = F.sort_array(F.collect_list(F.struct("cfg_ord", "configuration", "score", "compression", *(f for f in fields if f not in ("score", "compression")))))
    return labels.groupBy("key", "task").agg(F.max(F.when(F.col("cfg_ord") == 0, F.col("score"))).alias("base"), c.alias("c"))


def _best(of: str, *by: str) -> str:
    """The element of the array that is first by these, then by configuration."""
    order = ", ".join(f"{x} as a{k}" for k, x in enumerate(by))
    return f"{of}[array_min(transform({of}, (x, i) -> struct({order}, x.cfg_ord as b, i as i))).i]"


def _iso(of: str, tau: float) -> str:
    """The element of largest ratio among those that keep tau of ``base``, else that of the best score, then ratio."""
    ok = f"filter({of}, x -> x.score >= {tau}D * base)"
    return f"if(exists({of}, x -> x.score >= {tau}D * base), {_best(ok, '-x.compression')}, {_best(of, '-x.score', '-x.compression')})"


#: What is carried of the selected configuration, if it is there.
OUTPUT_FIELDS = ("score", "prediction", "kv_bytes", "kv_bytes_fp16", "compression", "generated_token_count", "kv_accounting")


def attach(labels: DataFrame, tau: float = 0.99) -> DataFrame:
    """Per item both oracles' choices side by side: every output field of the selected configuration that the labels have,
    fallback, threshold, whether the choice is below it, and the eligible set."""
    fields = [f for f in OUTPUT_FIELDS if f in labels.columns]
    items = gathered(labels, *fields).withColumn("c", F.expr("filter(c, x -> x.cfg_ord >= 1)"))
    items = items.withColumn("_p", F.expr(_iso("c", tau))).withColumn("_q", F.expr(_best("c", "-x.score", "-x.compression")))
    items = items.withColumn("threshold", F.lit(tau) * F.col("base")).withColumn("eligible", F.expr("transform(filter(c, x -> x.score >= threshold), x -> x.configuration)"))
    out = [F.col(f"_{o}.{f}").alias(f"{name}_{f}") for o, name in (("p", "primary"), ("q", "quality")) for f in ("configuration", *fields)]
    return items.select("key", "task", *out, (F.size("eligible") == 0).alias("primary_fallback"), "threshold", (F.col("_p.score") < F.col("threshold")).alias("below_threshold"), F.sort_array("eligible").alias("eligible"))


def oracle_summary(labels: DataFrame, tau: float = 0.99) -> DataFrame:
    """One row for the iso-quality oracle: rollups, fallbacks and violations with their shares, and selections per candidate.

    A choice below its threshold that is no fallback cannot be; it raises.
    """
    from ledgerline.operators.aggregate import summary

    chosen = iso_quality(labels, tau).withColumn("below", F.col("score") < tau * F.col("base"))
    wrong = F.count_if(F.col("below") & ~F.col("fallback"))
    n, back = F.count("*"), F.count_if("fallback")
    candidates = [r[0] for r in labels.filter("cfg_ord >= 1").select("configuration").distinct().orderBy("configuration").collect()]  # a handful
    counts = chosen.agg(
        back.alias("fallback_count"), F.try_divide(back, n).alias("fallback_fraction"), (n - back).alias("nonfallback_count"),
        F.when(wrong > 0, F.raise_error(F.lit("an eligible choice lies below its threshold")).cast("long")).otherwise(wrong).alias("violation_count"),
        F.when(n > back, wrong / (n - back)).otherwise(0.0).alias("violation_fraction"), *(F.count_if(F.col("configuration") == c).alias(f"selected_{c}") for c in candidates),
    )
    return summary(chosen).crossJoin(counts)  # one row each


def dataset_labels(labels: DataFrame, taus: tuple[float, ...] = (0.99, 0.95, 0.90)) -> DataFrame:
    """Training labels over all configurations, the baseline too: best quality, and iso-quality at each tau. All from one gathering by item."""
    iso = [F.expr(f"({_iso('c', tau)}).configuration").alias(f"iso_{int(tau * 100)}") for tau in taus]
    return gathered(labels).select("key", "task", F.expr(f"({_best('c', '-x.score')}).configuration").alias("best_quality"), *iso)


def best_fixed(labels: DataFrame) -> DataFrame:
    """The candidate of the highest mean score; the first wins ties."""
    means = labels.filter("cfg_ord >= 1").groupBy("configuration").agg(F.avg("score").alias("q"))
    return means.orderBy(F.desc("q"), "configuration").limit(1)


def random_router(labels: DataFrame) -> DataFrame:
    """Expected quality and ratio of choosing a candidate at random: N over the summed mean inverse ratios."""
    item = labels.filter("cfg_ord >= 1").groupBy("key").agg(F.avg("score").alias("q"), F.avg(1 / F.col("compression")).alias("inv"))
    return item.agg(F.avg("q").alias("q"), (F.count("*") / F.sum("inv")).alias("cr"), F.count("*").alias("n"))
