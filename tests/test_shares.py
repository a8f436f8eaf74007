"""Shares of budgets dealt in all groups together, against the plain rounds of one group; entropy against counted words."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import kernels as K
from ledgerline.functions.features import entropy

SCHEMA = "g string, item long, weight double, cap long, total long"


def dealt(spark, rows):
    return {(r.g, r.item): r.share for r in K.allocate(spark.createDataFrame(rows, SCHEMA), "g", "total").collect()}


def test_groups_get_what_each_would_alone(spark):
    draw = random.Random(5)
    groups = {
        "even": (10, [0, 0, 0], [3, 9, 9]), "caps": (100, [1, 2, 3], [5, 5, 5]), "rest": (7, [1, 1, 1, 1], [9, 9, 9, 9]), "one": (5, [2], [9]), "none": (0, [1, 2], [3, 3]),
        "shut": (9, [1, 2], [0, 0]), "part shut": (9, [5, 2, 1], [0, 4, 9]), "minus": (10, [3, -1, 2], [100, 100, 100]), "large": (10**12, [1, 3], [10**12, 10**12]),
    }
    for k in range(12):
        n = draw.randint(1, 40)
        groups[f"r{k}"] = (draw.randint(0, 900), [draw.choice((0, 1, 2, 5, 17, 64)) for _ in range(n)], [draw.randint(0, 50) for _ in range(n)])
    rows = [(g, i, float(w), c, total) for g, (total, weights, caps) in groups.items() for i, (w, c) in enumerate(zip(weights, caps, strict=True))]
    draw.shuffle(rows)
    want = {(g, i): x for g, (total, weights, caps) in groups.items() for i, x in enumerate(K.water_fill(total, weights, caps))}
    assert dealt(spark, rows) == want


def test_null_group_weight_and_cap_and_no_rows(spark):
    assert dealt(spark, [(None, 0, 1.0, 9, 6), (None, 1, 2.0, 9, 6), ("a", 0, None, 4, 6), ("a", 1, 1.0, None, 6)]) == {(None, 0): 2, (None, 1): 4, ("a", 0): 4, ("a", 1): 0}
    assert dealt(spark, []) == {}


def test_entropy_is_that_of_the_counts(spark):
    draw = random.Random(3)
    lists = [[], ["a"], ["a", "a"], ["a", "b"], [draw.choice("abcdefgh") for _ in range(500)], [str(i) for i in range(300)], ["", "", "x"]]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>").select("i", entropy(F.col("x")).alias("e"), entropy(F.transform("x", lambda w: F.hash(w))).alias("codes")).collect()
    for r in found:
        n, counts = len(lists[r.i]), Counter(lists[r.i])
        want = -sum(c / n * math.log2(c / n) for c in counts.values())
        assert (r.e, r.codes) == (pytest.approx(want, abs=1e-9), pytest.approx(want, abs=1e-9))
