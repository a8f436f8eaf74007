"""Ranks by value ranges against whole-group windows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators import aggregate as A
from ledgerline.operators import router as R
from ledgerline.operators.ranks import quantiles, range_rank, running_sum


def test_ranks_are_row_numbers(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, rng.random(), rng.randint(0, 9) / 3]), i) for i in range(3000)] + [("c", 1.0, 1)]
    table = spark.createDataFrame(rows, "g string, x double, t long")
    want = table.withColumn("_rank", F.row_number().over(W.partitionBy("g").orderBy("x", "t")))
    got = range_rank(table, ["g"], F.col("x"), "t", parts=7)
    assert sorted(map(tuple, want.select("g", "t", "_rank").collect())) == sorted(map(tuple, got.select("g", "t", "_rank").collect()))
    assert {r.g: r["_all"] for r in got.collect()} == {r.g: r.n for r in table.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert not range_rank(table.limit(0), ["g"], F.col("x"), "t").count()


def test_running_sums(spark):
    table = spark.createDataFrame([(i * 0.37 % 11, i % 5 + 1) for i in range(500)], "m double, t long").groupBy("m").agg(F.sum("t").alias("t"))
    rows = sorted((r.m, r.t) for r in table.collect())
    want, total = {}, 0
    for m, t in rows:
        want[m] = total
        total += t
    assert {r.m: r.before for r in running_sum(table, "m", "t", "before", parts=9).collect()} == want


def test_warm_up_rows_are_left_out(spark):
    table = spark.createDataFrame([(g, i * 7919 % 1009, float(i)) for g in "ab" for i in range(1009)] + [("c", 1, 2.0)], "g string, n long, ms double")
    rank = F.row_number().over(W.partitionBy("g").orderBy("n"))
    want = table.withColumn("r", rank).filter("r > 3").groupBy("g").agg(F.count("*").alias("n"), F.percentile("ms", F.lit(0.5)).alias("median"))
    got = A.latency(table, "ms", "n", 3, "g").select("g", "n", "median")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_seeded_folds_are_even(spark):
    items = spark.createDataFrame([(f"t{i % 3}", i) for i in range(200)], "task string, key long")
    a, b = ({r.key: r.fold for r in R.seeded_folds(items, 4, seed).collect()} for seed in (0, 1))
    assert a != b and len(a) == 200
    for task in range(3):
        sizes = [sum(f == k for key, f in a.items() if key % 3 == task) for k in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_null_groups_ties_and_a_constant_group(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.choice([None, 0.0, 0.0, 0.0, rng.random()]), rng.randrange(400)) for _ in range(4000)]
    table = spark.createDataFrame(rows, "g string, x double, t long")
    want = table.withColumn("_rank", F.row_number().over(W.partitionBy("g").orderBy("x", "t"))).select("g", "x", "t", "_rank")
    got = range_rank(table, ["g"], F.col("x"), "t", parts=9).select("g", "x", "t", "_rank")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(key, want.collect())) == sorted(map(key, got.collect()))


def test_a_constant_group_is_spread(spark):
    table = spark.range(100_000).select(F.lit("c").alias("g"), F.lit(1.0).alias("x"), F.col("id").alias("t"))
    ranked = range_rank(table, ["g"], F.col("x"), "t").withColumn("wrong", (F.col("_rank") != F.col("t") + 1).cast("int"))
    assert ranked.agg(F.sum("wrong")).first()[0] == 0
    from ledgerline.operators.ranks import by_ranges

    sizes = [r["count"] for r in by_ranges(table, ["g"], F.col("x"), tie="t").groupBy("g", "_b", "_c").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 5_000


def test_quantiles(spark):
    rng = random.Random(9)
    table = spark.createDataFrame([(rng.choice(["a", None, "b"]), rng.choice([None, 3.0, rng.random()])) for _ in range(2000)] + [("one", 4.0), ("none", None)], "g string, x double")
    want = table.filter("x is not null").groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m"), F.percentile("x", F.lit(0.95)).alias("h"))
    near = lambda rows: sorted((r.g or "", round(r.m, 9), round(r.h, 9)) for r in rows)
    assert near(quantiles(table, ["g"], "x", {"m": 0.5, "h": 0.95}).collect()) == near(want.collect())
    assert quantiles(table.limit(0), ["g"], "x", {"m": 0.5}).count() == 0


def test_warm_up_with_ties_and_a_null_group(spark):
    table = spark.createDataFrame([(g, n, float(k)) for g in ("a", None) for k, n in enumerate([1, 1, 1, 1, 1, 2, 3, 4, 5, 6])] + [("few", 1, 9.0), ("void", 5, None), ("void", 6, None), ("void", 7, None)], "g string, n long, ms double")
    got = {r.g: (r.median, r.n) for r in A.latency(table, "ms", "n", 2, "g").collect()}
    assert got == {"a": (5.5, 8), None: (5.5, 8), "void": (None, 1)}
    text = A.latency(table.withColumn("n", F.col("n").cast("string")), "ms", "n", 2, "g")
    assert {r.g: (r.median, r.n) for r in text.collect()} == got
