"""Paired comparisons: bootstrap, Wilcoxon signed rank, win/tie/loss, random routing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.operators.ranks import running_sum


#: The most pairs whose p value is taken from the exact distribution.
EXACT_PAIRS = 50


def win_tie_loss(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count_if(d > 0).alias("win"), F.count_if(d == 0).alias("tie"), F.count_if(d < 0).alias("loss"), F.avg(d).alias("mean_difference"))


def paired_bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 12345, a: str = "a", b: str = "b", key: str = "key") -> DataFrame:
    """``mean``, ``low``, ``high`` (95 %), ``p`` of the mean paired difference.

    Distributed resampling by Poisson(1) weights: each row's weights for all
    resamples are drawn from its key and the seed, so that they do not depend
    on partitions or order, and every partition returns two sums per resample,
    so no task holds all rows. Rows without a ``key`` draw by their values. p is twice the smaller tail, as defined
    not capped at one.
    """

    def draw(batches):
        import pyarrow as pa

        s, n = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for d, key in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), strict=True):
                w = np.random.default_rng([seed, key & (1 << 64) - 1]).poisson(1.0, resamples)
                s += w * d
                n += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(s), pa.array(n)], names=["r", "s", "n"])

    d = (F.col(a) - F.col(b)).cast("double")
    means = pairs.select(d.alias("d"), F.xxhash64(*([key] if key in pairs.columns else pairs.columns)).alias("k")).mapInArrow(draw, "r long, s double, n double").groupBy("r").agg(F.round(F.sum("s") / F.sum("n"), 12).alias("m"))
    tails = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), (2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p"))
    return pairs.agg(F.avg(d).alias("mean")).crossJoin(tails)  # one row each


def wilcoxon(pairs: DataFrame, zeros: str = "wilcox", a: str = "a", b: str = "b") -> DataFrame:
    """Signed-rank statistic, effective n, z and two-sided p: exact for up to ``EXACT_PAIRS`` pairs without zero differences and ties, else by the normal approximation with tie correction.

    Zero differences are dropped (``wilcox``) or ranked and then dropped
    (``pratt``). Average ranks come from the counts of distinct magnitudes, so
    only those are ordered, by value ranges. Without any difference z is null.
    """
    d = F.round(F.col(a) - F.col(b), 12)
    sizes = pairs.select(d.alias("d")).filter("d is not null").groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("pos"))
    if zeros == "wilcox":
        sizes = sizes.filter("m > 0")
    ranked = running_sum(sizes, "m", "t", "before").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    used = F.col("m") > 0
    t = F.col("t").cast("double")
    sums = ranked.agg(F.sum(F.when(used, F.col("pos") * F.col("rank"))).alias("w_plus"), F.sum(F.when(used, (t - F.col("pos")) * F.col("rank"))).alias("w_minus"), F.sum(t).alias("n"), F.sum(F.when(~used, t).otherwise(0.0)).alias("z0"), F.sum(F.when(used, t * t * t - t).otherwise(0.0)).alias("ties"))
    n, z0 = F.col("n"), F.col("z0")
    mean = (n * (n + 1) - z0 * (z0 + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - F.col("ties") / 2) / 24
    z = F.when(var > 0, (F.least("w_plus", "w_minus") - mean) / F.sqrt(var))
    # exact for few pairs without zero differences and ties, the normal form otherwise
    exact = (n - z0 <= EXACT_PAIRS) & (F.col("zeros") == 0) & (F.col("ties") == 0) & (n > 0)
    out = sums.crossJoin(pairs.agg(F.count_if(d == 0).alias("zeros"))).select(F.least("w_plus", "w_minus").alias("statistic"), (n - z0).cast("long").alias("n"), z.alias("z"), exact.alias("exact"))  # one row each
    return out.withColumn("p", F.when(F.col("exact"), exact_two_sided(F.when(F.col("exact"), F.col("statistic")), "n")).otherwise(normal_two_sided(F.col("z"))))


def signed_rank_counts(n: int) -> list[int]:
    """Of the 2 ** n ways to sign the ranks 1 to n, how many have positive ranks that sum to 0, 1, 2, ..."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for total, count in enumerate(ways):
            longer[total + rank] += count
        ways = longer
    return ways


@F.pandas_udf(DoubleType())
def exact_two_sided(statistic: pd.Series, n: pd.Series) -> pd.Series:
    """Twice the share of sign patterns whose smaller rank sum is at most the statistic, 1 at most."""
    p = lambda w, m: min(1.0, 2 * sum(signed_rank_counts(int(m))[: int(w) + 1]) / 2 ** int(m)) if pd.notna(w) else None
    return pd.Series([p(w, m) for w, m in zip(statistic, n, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype(float)


def random_router_draws(labels: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Monte-Carlo mean and population deviation of the quality of random candidates.

    Each item's candidates for all draws come from its key and the seed, whatever the partition; partitions return sums.
    """
    items = labels.filter("cfg_ord >= 1").groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("cfg_ord", "score"))), lambda x: x["score"]).alias("s"))

    def draw(batches):
        import pyarrow as pa

        total, n = np.zeros(draws), 0
        for batch in batches:
            for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.asarray(s)[np.random.default_rng([seed, key & (1 << 64) - 1]).integers(0, len(s), draws)]
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(np.full(draws, n))], names=["r", "s", "n"])

    per = items.select("s", F.xxhash64("key").alias("k")).mapInArrow(draw, "r long, s double, n long").groupBy("r").agg(F.round(F.sum("s") / F.sum("n"), 12).alias("q"))
    return per.agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("sd"), F.count("*").alias("draws"))
