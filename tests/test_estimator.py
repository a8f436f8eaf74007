"""The router as an estimator and model: the same rows as ``decide``, saved and loaded, and in a search over taus and pools."""

import random

from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from ledgerline.operators import router as R
from ledgerline.operators.estimator import RoutedQuality, RouterEstimator, RouterModel


def panel(spark, n=90):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        base = rng.random()
        rows += [(f"t{k % 2}", k, f"C{c}", c, base - c / 20 * rng.random(), 1.0 + c, base - c / 25, k % 3) for c in range(4)]
    return spark.createDataFrame(rows, "task string, key long, configuration string, cfg_ord int, score double, compression double, prediction double, fold int")


def plain(rows):
    return sorted((r.key, r.configuration, r.reason, tuple(r.eligible), tuple(r.ranked), round(r.base_pred, 9), r.fold) for r in rows.collect())


def test_same_rows_as_decide_for_a_fold(spark):
    labels = panel(spark).cache()
    train, held = labels.filter("fold != 1"), labels.filter("fold = 1")
    folds = labels.select("key", "fold").distinct()
    stats = R.train_stats(labels.drop("fold", "prediction"), folds)
    for tau, floor in ((0.9, True), (0.9, False), (0.99, True)):
        model = RouterEstimator(tau=tau, useFloor=floor).fit(train)
        assert plain(model.transform(held)) == plain(R.decide(held, stats.filter("fold = 1"), tau, use_floor=floor))
    narrow = RouterEstimator(tau=0.9, pool=["C2", "C3"]).fit(train).transform(held)
    assert {r.configuration for r in narrow.collect()} <= {"C2", "C3"}


def test_saved_and_loaded(spark, tmp_path):
    labels = panel(spark)
    estimator = RouterEstimator(tau=0.93, pool=["C1", "C3"])
    estimator.save(str(tmp_path / "e"))
    assert RouterEstimator.load(str(tmp_path / "e")).extractParamMap().values().__len__() == 3
    model = estimator.fit(labels)
    model.save(str(tmp_path / "m"))
    again = RouterModel.load(str(tmp_path / "m"))
    assert (again.getOrDefault("tau"), again.getOrDefault("pool"), again.getOrDefault("stats")) == (0.93, ["C1", "C3"], model.getOrDefault("stats"))
    assert plain(again.transform(labels)) == plain(model.transform(labels))


def test_search_over_taus(spark):
    labels = panel(spark).cache()
    estimator = RouterEstimator()
    grid = ParamGridBuilder().addGrid(estimator.tau, [0.5, 0.99]).build()
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=RoutedQuality(metric="compression"), numFolds=3, foldCol="fold")
    found = search.fit(labels.drop("task"))
    assert found.bestModel.getOrDefault("tau") == 0.5 and found.avgMetrics[0] > found.avgMetrics[1]


def test_empty_table(spark):
    model = RouterEstimator().fit(panel(spark))
    assert model.transform(panel(spark).limit(0)).count() == 0
    assert RouterEstimator().fit(panel(spark).limit(0)).transform(panel(spark).filter(F.col("key") < 0)).count() == 0
