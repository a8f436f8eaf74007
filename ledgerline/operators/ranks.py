"""Ranks, quantiles and running sums within groups, by value ranges, so that no task sorts a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

PARTS = 64


def same(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` with what the small table ``b`` has of its group; a null group is a group like any other."""
    names = {c: f"_of_{i}" for i, c in enumerate(by)}
    small = F.broadcast(b.select(*(F.col(c).alias(names.get(c, c)) for c in b.columns)))  # one row a group, or a group and range
    if not by:
        return a.crossJoin(small)
    return a.join(small, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items())), how).drop(*names.values())


def below(cuts: str, x: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < x))


def by_ranges(rows: DataFrame, by: list[str], value: Column, parts: int = PARTS, tie: str | None = None) -> DataFrame:
    """Adds ``_v``, the value as a double, and ``_b``, its range within the group: cut at approximate quantiles, nulls first.

    A value that two cuts fall on (and null) has a range of its own, and such
    ranges are cut again (``_c``) by ``tie`` if that is a number, so that equal values are spread too.
    """
    rows = rows.withColumn("_v", value.cast("double"))
    points = [i / parts for i in range(1, parts)]
    cut_ties = tie is not None and isinstance(rows.schema[tie].dataType, NumericType)
    cuts = [F.percentile_approx("_v", points, 1000).alias("_cuts")]
    if cut_ties:
        cuts.append(F.percentile_approx(F.col(tie).cast("double"), points, 1000).alias("_ties"))
    cuts = rows.groupBy(*by).agg(*cuts).withColumn("_hot", F.expr("array_distinct(filter(_cuts, (c, i) -> i > 0 and c = _cuts[i - 1]))"))  # mostly empty
    joined = same(rows, cuts, by)
    hot = F.coalesce(F.array_contains("_hot", F.col("_v")), F.lit(False))
    place = F.when(F.col("_v").isNull() | F.col("_cuts").isNull(), -1).otherwise(2 * below("_cuts", F.col("_v")) + hot.cast("int"))
    again = F.coalesce(below("_ties", F.col(tie).cast("double")), F.lit(-1)) if cut_ties else F.lit(0)
    alone = hot | F.col("_v").isNull()
    return joined.withColumn("_b", place).withColumn("_c", F.when(alone, again).otherwise(0)).drop("_cuts", "_ties", "_hot")


def _before(sums: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Adds ``_before``, the sum over the lower ranges of the group, and ``_all``; some hundreds of rows a group at most."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    lower = F.sum(amount).over(w.orderBy("_b", "_c").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("_before", F.coalesce(lower, F.lit(0))).withColumn("_all", F.sum(amount).over(w)).drop(amount)


def range_rank(rows: DataFrame, by: list[str], value: Column, *ties, name: str = "_rank", parts: int = PARTS) -> DataFrame:
    """Adds the row's number within its group by value, then ties, as ``row_number`` has it, and ``_all``, the group's rows.

    Null groups are a group and nulls come first, as in a window. A value that
    most rows share is spread over ranges of the first of ``ties``, if that is a numeric column.
    """
    tie = next((t for t in ties[:1] if isinstance(t, str)), None)
    ranged = by_ranges(rows, by, value, parts, tie)
    sums = _before(ranged.groupBy(*by, "_b", "_c").agg(F.count("*").alias("_n")), by, "_n")
    local = F.row_number().over(W.partitionBy(*by, "_b", "_c").orderBy("_v", *ties))
    return same(ranged.withColumn("_local", local), sums, [*by, "_b", "_c"]).withColumn(name, F.col("_local") + F.col("_before")).drop("_v", "_b", "_c", "_local", "_before")


def quantiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float], tie: str | None = None) -> DataFrame:
    """Per group the exact quantiles of ``value`` that are named in ``points``, interpolated between neighbours; nulls are left out.

    Only the two rows next to each quantile leave the ranked table, so no task
    holds a group's values. A group of nulls alone has no row.
    """
    ties = [tie] if tie else []
    ranked = range_rank(rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), *ties), by, F.col("_x"), *ties)
    cells = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_all") - 1)
        low = F.max(F.when(F.col("_rank") - 1 == F.floor(at), F.col("_x")))
        high = F.max(F.when(F.col("_rank") - 1 == F.ceil(at), F.col("_x")))
        part = F.max(at - F.floor(at))
        cells.append(F.when(part > 0, low * (1 - part) + high * part).otherwise(low).alias(name))
    return ranked.groupBy(*by).agg(*cells)


def running_sum(rows: DataFrame, value: str, amount: str, name: str, parts: int = PARTS) -> DataFrame:
    """Adds the sum of ``amount`` over all rows of smaller value; values are distinct."""
    ranged = by_ranges(rows, [], F.col(value), parts)
    sums = _before(ranged.groupBy("_b", "_c").agg(F.sum(amount).alias("_n")), [], "_n")
    local = F.sum(amount).over(W.partitionBy("_b", "_c").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    return same(ranged.withColumn("_local", F.coalesce(local, F.lit(0))), sums, ["_b", "_c"]).withColumn(name, F.col("_local") + F.col("_before")).drop("_v", "_b", "_c", "_local", "_before", "_all")
