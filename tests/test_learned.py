"""Distributed fits: no fit sees its fold, predictions are made once and found again by content."""

import inspect

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import learned as L
from ledgerline.operators import router as R
from ledgerline.operators import sweep as P

FAST = L.Settings(rounds=4, depth=2, rate=0.7, bins=16, least=1)


def panel(spark, n=120, folds=2, configurations=3):
    """Scores that follow the first feature; key % folds is the fold."""
    rows = [("t", k, f"C{c}", c, (k % 7) / 7 + c / 100, 1.0 + c) for k in range(n) for c in range(configurations)]
    labels = spark.createDataFrame(rows, "task string, key long, configuration string, cfg_ord int, score double, compression double")
    features = spark.createDataFrame([(k, float(k % 7), None if k % 5 else 1.0) for k in range(n)], "key long, a double, b double")
    return labels, features, labels.select("key", (F.col("key") % folds).cast("int").alias("fold")).distinct()


def test_published_settings(spark):
    s = L.Settings()
    assert (s.rounds, s.depth, s.rate, s.bins, s.least, s.seed) == (300, 4, 0.05, 255, 20, 42)
    steps = L.learner(["a"], "s0", "p", s).getStages()
    assert (steps[2].getMaxIter(), steps[2].getMaxDepth(), steps[2].getStepSize(), steps[2].getMaxBins(), steps[2].getMinInstancesPerNode()) == (300, 4, 0.05, 255, 20)
    assert "applyInPandas" not in inspect.getsource(L)


def test_fits_beat_the_mean_and_report_counts(spark):
    labels, features, folds = panel(spark)
    rows = L.items(labels, features, folds).cache()
    got = L.fit_report(labels, rows, L.predictions(rows, FAST)).collect()
    assert len(got) == 6
    for r in got:
        assert (r.train_rows, r.test_rows) == (60, 60) and r.mae < r.mean_mae / 2 and r.r2 > 0.7


def test_no_fit_sees_its_fold(spark):
    rows = spark.createDataFrame([(k, k % 2, float(k % 2), float(k % 3)) for k in range(60)], "key long, fold int, s0 double, a double")
    assert {(r.fold, round(r.prediction, 9)) for r in L.predictions(rows, FAST).collect()} == {(0, 1.0), (1, 0.0)}


def test_null_scores_features_folds_and_small_tables(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else "x" if k % 3 == 1 else "y", None if k == 1 else k / 30, -1.0) for k in range(30)], "key long, fold string, s1 double, a double")
    got = L.predictions(rows, FAST).collect()
    assert sorted(r.key for r in got) == list(range(30)) and {r.cfg_ord for r in got} == {1} and all(r.prediction == r.prediction for r in got)
    assert L.predictions(rows.limit(0), FAST).count() == 0 and L.predictions(rows.filter("fold = 'x'"), FAST).count() == 0


def test_predictions_are_made_once_for_a_sweep(spark, tmp_path, monkeypatch):
    labels, features, folds = panel(spark)
    rows = L.items(labels, features, folds)
    calls, real = [], L.predictions
    monkeypatch.setattr(L, "predictions", lambda *a: calls.append(1) or real(*a))
    stats, store = R.train_stats(labels, folds), str(tmp_path)
    for _ in range(2):
        predicted = L.stored_predictions(rows, FAST, store)
        points = P.points(spark, (0.8, 0.9, 0.95, 0.99, 1.0))
        found = R.decide(labels.join(predicted, ["key", "cfg_ord"]), stats, points=points)
        assert found.select("pool_key", "tau").distinct().count() >= 5
    assert len(calls) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and f"{store}/" in str(predicted.inputFiles())
    other = L.stored_predictions(rows.withColumn("s0", F.col("s0") + F.when(F.col("key") == 3, 1e-6).otherwise(0.0)), FAST, store)
    assert len(calls) == 2 and other.inputFiles() != predicted.inputFiles()
    assert L.address(rows.orderBy(F.desc("key")).repartition(3), FAST) == L.address(rows, FAST) != L.address(rows, L.Settings())
    path = predicted.inputFiles()[0].rpartition("/")[0]
    L.require_fresh(path, rows, FAST)
    with pytest.raises(ValueError, match="other scores"):
        L.require_fresh(path, rows.filter("key > 0"), FAST)


def test_texts_are_read_once_for_labels_features_and_folds(spark, tmp_path):
    """The panel is a staged table of numbers; fits, report and routing read that and no text again."""
    texts = [(1, "en", "a b c " * 3), (2, "en", " \t\n"), (3, None, None), (4, "de", "x"), (5, "de", "  y z?\n\ny")] + [(10 + k, "en", " ".join(f"w{(i * k) % 97}" for i in range(k))) for k in (15, 16, 17, 32, 33, 128, 257, 300)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels, folds, rows, predicted = L.cross_validated(spark, str(tmp_path), s=FAST, store=str(tmp_path / "store"))
    for table in (labels, folds, rows, predicted):
        assert table.inputFiles() and not any("documents.parquet" in f for f in table.inputFiles())
    got = {(r.key, r.cfg_ord): (r.score, r.compression) for r in labels.collect()}
    want = {}
    for key, _, text in texts:
        w = (text or "").split()
        for c, cap in enumerate((None, 256, 128, 64, 32, 16)):
            kept = w if cap is None or len(w) <= cap else w[: cap // 2] + w[-(cap // 2) :]
            if w:
                want[key, c] = (len(set(kept)) / len(set(w)), len(w) / len(kept))
    assert got == want
    assert {r.key for r in rows.collect()} == {key for key, c in want} and predicted.count() == len(want)


def test_predictions_do_not_depend_on_how_rows_lie(spark, tmp_path):
    """Over 10,000 rows the learner samples its candidate splits; the same rows in other partitions and order are fitted alike."""
    rows = spark.range(24_000).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("fold"), (F.xxhash64("id") % 1000 / 1000.0 + F.sqrt("id")).alias("s0"), F.sqrt("id").alias("a"))
    one, other = (L.stored_predictions(r, FAST, str(tmp_path / n)) for n, r in (("one", rows), ("other", rows.repartition(3, F.xxhash64("key", F.lit(1))).sortWithinPartitions(F.desc("key")))))
    assert one.count() == 24_000 and one.exceptAll(other).count() == 0
