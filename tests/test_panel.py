import pytest
from pyspark.sql import functions as F

from ledgerline.functions.kernels import water_fill
from ledgerline.operators import aggregate as A
from ledgerline.operators import oracle as O
from ledgerline.operators import router as R
from ledgerline.operators import stats as S
from ledgerline.operators import sweep as P
from ledgerline.operators import validate as V


@pytest.fixture
def labels(spark):
    scores, ratios = (0.70, 0.80, 0.90, 0.90, 0.60, 0.50), (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    rows = [(f"t{k % 3}", f"c{k % 3}", k, f"C{i}", i, scores[i], 600.0 / ratios[i], 600.0, ratios[i]) for k in range(12) for i in range(6)]
    return spark.createDataFrame(rows, "task string, category string, key long, configuration string, cfg_ord int, score double, kv_bytes double, kv_bytes_fp16 double, compression double")


def test_iso_oracle_ties_and_fallback(labels):
    assert {r.configuration for r in O.iso_quality(labels).collect()} == {"C3"}
    tie = labels.withColumn("compression", F.when(F.col("cfg_ord") == 2, 4.0).otherwise(F.col("compression")))
    assert {r.configuration for r in O.iso_quality(tie).collect()} == {"C2"}
    low = labels.withColumn("score", F.when(F.col("cfg_ord") >= 1, 0.5).otherwise(F.col("score")))
    assert {(r.configuration, r.fallback) for r in O.iso_quality(low).collect()} == {("C5", True)}


def test_rollups(spark):
    rows = spark.createDataFrame([(f"t{i}{j}", f"c{i}", (i + 1) / 10, float(i + 1)) for i in range(6) for j in range(2) for _ in range(j + 1)], "task string, category string, score double, compression double")
    got = A.quality_rollup(rows).first()
    assert abs(got.macro - 0.35) < 1e-12 and got.n == 18
    assert abs(A.compression_rollup(rows).first().category_balanced - 3.5) < 1e-12
    with pytest.raises(Exception, match="positive"):
        A.compression_rollup(rows.withColumn("compression", F.lit(0.0))).collect()


def test_folds_hold_out_each_item_once(labels):
    folds = R.stratified_folds(labels, 4)
    assert folds.count() == 12 and folds.select("key").distinct().count() == 12
    stats = R.train_stats(labels, folds)
    assert {r.train_n for r in stats.collect()} == {9}
    chosen = R.decide(R.mean_predictions(labels, folds), stats)
    assert {(r.configuration, r.reason) for r in chosen.collect()} == {("C3", "eligible")}


def test_router_ignores_held_out_ratio(labels):
    folds = R.stratified_folds(labels, 2)
    spoiled = labels.join(folds, "key").withColumn("compression", F.when((F.col("fold") == 0) & (F.col("cfg_ord") == 1), 100.0).otherwise(F.col("compression"))).drop("fold")
    got = R.decide(R.mean_predictions(spoiled, folds), R.train_stats(spoiled, folds))
    assert {r.configuration for r in got.filter("fold = 0").collect()} == {"C3"}


def test_frontier_matches_all_pairs(spark):
    import random

    rng = random.Random(3)
    pts = [(rng.randint(0, 6) / 6, rng.randint(0, 6) / 1.0) for _ in range(60)]
    want = sorted(p for p in pts if not any(o[0] >= p[0] and o[1] >= p[1] and o != p for o in pts))
    got = sorted((r.q, r.cr) for r in P.frontier(spark.createDataFrame(pts, "q double, cr double")).collect())
    assert got == want


def test_pools_and_parsing(spark):
    rows = P.pools(spark).collect()
    assert len(rows) == 26 and {r.size for r in rows} == {2, 3, 4, 5}
    assert P.parse_pools("C3,C2; C1,C4;C2,C3") == [("C2", "C3"), ("C1", "C4")]
    with pytest.raises(ValueError):
        P.parse_taus("1.5")


def test_journal(spark):
    events = spark.createDataFrame([("a", 1, "completed"), ("b", 1, "failed"), ("b", 2, "completed"), ("c", 1, "completed"), ("c", 2, "failed"), ("d", 2, "failed")], "k string, attempt int, status string")
    got = {r.k: (r.attempts, r.latest, r.failures, r.invalid) for r in V.journal(events, "k").collect()}
    assert got == {"a": (1, "completed", 0, 0), "b": (2, "completed", 1, 0), "c": (2, "failed", 1, 1), "d": (1, "failed", 1, 1)}
    assert [r.k for r in V.pending(events.select("k").distinct(), events, "k").collect()] == ["d"]


def test_checks(labels):
    assert not V.value_violations(labels).count()
    broken = labels.withColumn("score", F.when(F.col("key") == 1, F.lit(float("nan"))).otherwise(F.col("score")))
    assert {r.key for r in V.value_violations(broken).collect()} == {1}
    assert V.same_rows(labels, labels) and not V.same_rows(labels, labels.limit(3))


def test_wilcoxon_small(spark):
    pairs = spark.createDataFrame([(float(x), 0.0) for x in (1, 2, -3, 4, 5, 0)], "a double, b double")
    got = S.wilcoxon(pairs).first()
    assert (float(got.statistic), got.n) == (3.0, 5)
    assert float(S.wilcoxon(pairs, "pratt").first().statistic) == 4.0
    none = S.wilcoxon(spark.createDataFrame([(1.0, 1.0)], "a double, b double")).first()
    assert none.z is None


def test_bootstrap(spark):
    pairs = spark.createDataFrame([(i / 100 + 0.5, i / 100) for i in range(200)], "a double, b double")
    got = S.paired_bootstrap(pairs, 200).first()
    assert abs(got.mean - 0.5) < 1e-9 and got.p == 0.0


def test_water_fill():
    assert water_fill(10, [1, 1, 2], [10, 10, 10]) == [2, 2, 6]
    assert water_fill(10, [0, 0], [3, 9]) == [3, 7]
    assert sum(water_fill(7, [5, 1, 1], [2, 2, 9])) == 7
