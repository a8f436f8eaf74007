"""Operating points are evaluated on kinds of items, with the results of choosing item by item."""

import math

from pyspark.sql import functions as F

from ledgerline.operators import router as R
from ledgerline.operators import sweep as P
from ledgerline.plans import queries as Q

FIELDS = "key long, fold int, task string, cfg_ord int, configuration string, score double, compression double, prediction double"


def rows(n=90):
    """Few distinct predictions; ties, null scores and predictions, items without a candidate, without the baseline, or with nothing else."""
    out = []
    for k in range(n):
        for c in range(6):
            if (k % 9 == 4 and c == 2) or (k % 10 == 7 and c == 0) or (k % 11 == 5 and c):
                continue
            prediction = None if (k % 13 == 6 and c == 3) else ((k % 3) * 2 + c * (k % 2)) / 8
            out.append((k, k % 3, "t", c, f"C{c}", None if k % 17 == 8 else ((k * 7 + c * 5) % 23) / 23, 1.0 + c * (1 + k % 4), prediction))
    return out


def test_points_on_kinds_are_points_on_items(spark):
    predicted = spark.createDataFrame(rows(), FIELDS)
    stats = spark.createDataFrame([(f, f"C{c}", c, 0.4, 1.0 + (c * 7 % 5 if f else 1)) for f in range(3) for c in range(6)], "fold int, configuration string, cfg_ord int, train_q double, train_cr double")
    points = P.points(spark, (0.5, 0.9, 1.0), least=1)
    for floor in (False, True):
        want = {(r.pool_key, r.tau): r for r in P.evaluate(R.decide(predicted, stats, points=points, use_floor=floor)).collect()}
        got = {(r.pool_key, r.tau): r for r in R.evaluate_points(predicted, stats, points, floor).collect()}
        assert got.keys() == want.keys() and len(got) == 93
        for k, r in got.items():
            assert (r["size"], r.n) == (want[k]["size"], want[k].n)
            assert math.isclose(r.q, want[k].q, abs_tol=1e-12) and math.isclose(r.cr, want[k].cr, rel_tol=1e-12)
    none = R.evaluate_points(predicted.withColumn("score", F.lit(None).cast("double")), stats, points).select("q").distinct().collect()
    assert [r.q for r in none] == [None]


def test_sweep_queries_multiply_kinds_not_items(spark):
    for name in ("pool_sweep", "pareto_frontier", "best_operating_point"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [base_pred" in plan.partition("Join Cross")[2], name
