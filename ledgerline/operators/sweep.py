"""Candidate pools, operating points, Pareto comparison and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pools(spark: SparkSession, candidates: int = 5, least: int = 2, most: int = 5) -> DataFrame:
    """``pool_key``, ``pool``, ``size`` of all subsets of C1..Cn within the sizes, by size, then in order of their members."""
    members = F.expr(f"filter(sequence(1, {candidates}), i -> (bits & shiftleft(1, i - 1)) != 0)")
    rows = spark.range(1, 2**candidates).select(F.col("id").cast("int").alias("bits")).select(F.transform(members, lambda i: F.concat(F.lit("C"), i.cast("string"))).alias("pool"))
    return rows.select(F.array_join("pool", "+").alias("pool_key"), "pool", F.size("pool").alias("size")).filter(F.col("size").between(least, most))


def parse_pools(text: str, candidates: tuple[str, ...] = ("C1", "C2", "C3", "C4", "C5")) -> list[tuple[str, ...]]:
    """Pools such as ``C2,C3;C1,C4``: members in candidate order, repeated pools once, first come first."""
    found: dict[tuple[str, ...], None] = {}
    for part in filter(None, (x.strip() for x in text.split(";"))):
        names = {x.strip() for x in part.split(",") if x.strip()}
        if not names or names - set(candidates):
            raise ValueError(f"no pool of {', '.join(candidates)}: {part}")
        found[tuple(c for c in candidates if c in names)] = None
    return list(found)


def parse_taus(text: str) -> list[float]:
    taus = [float(x) for x in text.split(",") if x.strip()]
    if not taus or any(not 0 < t <= 1 for t in taus):
        raise ValueError("taus lie in (0, 1]")
    return taus


def points(spark: SparkSession, taus: tuple[float, ...], least: int = 2, most: int = 5) -> DataFrame:
    return pools(spark, least=least, most=most).crossJoin(spark.createDataFrame([(float(t),) for t in taus], "tau double"))  # a few dozen pools by a few taus


def evaluate(decisions: DataFrame) -> DataFrame:
    """Per operating point: mean score ``q``, harmonic ratio ``cr``, size, routed items."""
    return decisions.groupBy("pool_key", "tau").agg(F.first("size").alias("size"), F.avg("score").alias("q"), (F.count("*") / F.sum(1 / F.col("compression"))).alias("cr"), F.count("*").alias("n"))


def coverage_gaps(evaluated: DataFrame, items: int) -> DataFrame:
    """Operating points that did not route every held-out item exactly once."""
    return evaluated.filter(F.col("n") != items)


def frontier(rows: DataFrame, q: str = "q", cr: str = "cr") -> DataFrame:
    """Rows that no other dominates (no worse in both, better in one); equal rows all stay.

    A row is dominated if a row of strictly larger ratio has at least its
    quality, or one of the same ratio has more: a running maximum over the
    distinct ratios instead of a join of all pairs.
    """
    top = rows.groupBy(cr).agg(F.max(q).alias("_top"))
    above = F.max("_top").over(W.partitionBy(F.lit(1)).orderBy(F.desc(cr)).rowsBetween(W.unboundedPreceding, -1))
    limit = top.withColumn("_above", above)
    return rows.join(limit, cr).filter((F.col(q) == F.col("_top")) & (F.col("_above").isNull() | (F.col(q) > F.col("_above")))).drop("_top", "_above")


def best_point(evaluated: DataFrame, *by: str) -> DataFrame:
    """Highest q, then cr, then the smaller pool, then pool key, then larger tau."""
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(F.desc("q"), F.desc("cr"), "size", "pool_key", F.desc("tau"))
    return evaluated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def dominates(q: Column, cr: Column, other_q: Column, other_cr: Column) -> Column:
    return (q >= other_q) & (cr >= other_cr) & ((q > other_q) | (cr > other_cr))


def verdicts(point: DataFrame, fixed: DataFrame, digits: tuple[int, int] = (4, 3)) -> DataFrame:
    """A point against each fixed configuration, on rounded quality and ratio."""
    q, cr = (F.round(F.col("q"), digits[0]), F.round(F.col("cr"), digits[1]))
    p = point.select(q.alias("pq"), cr.alias("pcr"))
    f = fixed.select("configuration", q.alias("fq"), cr.alias("fcr"))
    a, b = (F.col("pq"), F.col("pcr")), (F.col("fq"), F.col("fcr"))
    verdict = F.when(dominates(*a, *b), "dominates").when(dominates(*b, *a), "dominated").otherwise("non_dominated")
    return f.crossJoin(F.broadcast(p)).select("configuration", verdict.alias("verdict"))  # one point


def best_dominating(evaluated: DataFrame, base_q: float, base_cr: float) -> DataFrame:
    """The best point among those that dominate the baseline; empty if none does."""
    return best_point(evaluated.filter(dominates(F.col("q"), F.col("cr"), F.lit(base_q), F.lit(base_cr))))


def cross_check(computed: DataFrame, stored: DataFrame, on: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """``status`` of each computed value against the stored one: match, mismatch, or not_available."""
    s = stored.select(*on, F.col(value).alias("_stored"))
    status = F.when(F.col("_stored").isNull(), "not_available").when(F.abs(F.col(value) - F.col("_stored")) <= tolerance, "match").otherwise("mismatch")
    return computed.join(s, on, "left").select(*on, value, status.alias("status"))
