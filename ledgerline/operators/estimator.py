"""The router as an estimator: fitting takes what training folds say of each configuration, transforming chooses one per item.

``RouterEstimator`` and ``RouterModel`` are ``pyspark.ml`` stages, so pools,
thresholds and folds go through ``ParamGridBuilder``, ``CrossValidator`` and saved pipelines.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.router import decide

STATS = "configuration string, cfg_ord int, train_q double, train_cr double"


class _RouterParams(Params):
    tau = Param(Params._dummy(), "tau", "share of the baseline's predicted score that a candidate has to keep", TypeConverters.toFloat)
    pool = Param(Params._dummy(), "pool", "configurations that may be chosen; none: all", TypeConverters.toListString)
    useFloor = Param(Params._dummy(), "useFloor", "whether the baseline's training mean is a lower bound of its predicted score", TypeConverters.toBoolean)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(tau=0.99, pool=[], useFloor=True)


class RouterEstimator(Estimator, _RouterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean score and harmonic ratio of each configuration from rows (``configuration``, ``cfg_ord``, ``score``, ``compression``)."""

    @keyword_only
    def __init__(self, *, tau: float = 0.99, pool: list[str] | None = None, useFloor: bool = True):  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RouterModel:
        ratio = F.count_if(F.col("compression") > 0) / F.sum(F.when(F.col("compression") > 0, 1 / F.col("compression")))
        rows = dataset.groupBy("configuration", "cfg_ord").agg(F.avg("score").alias("q"), F.coalesce(ratio, F.lit(1.0)).alias("cr")).orderBy("cfg_ord").collect()  # a row a configuration
        model = RouterModel(stats=json.dumps([[r.configuration, r.cfg_ord, r.q, r.cr] for r in rows]))
        return self._copyValues(model)


class RouterModel(Model, _RouterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses a configuration for each item of rows (``key``, ``configuration``, ``cfg_ord``, ``prediction``, any others), as ``decide`` does."""

    stats = Param(Params._dummy(), "stats", "name, ordinal, training mean and training ratio of each configuration, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, stats: str = "[]"):
        super().__init__()
        self._set(stats=stats)

    def training(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in json.loads(self.getOrDefault("stats"))], STATS)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if pool := self.getOrDefault("pool"):
            dataset = dataset.filter((F.col("cfg_ord") == 0) | F.col("configuration").isin(pool))
        rows = dataset.withColumn("_fold", F.lit(0))
        stats = self.training(dataset.sparkSession).withColumn("_fold", F.lit(0))
        renamed = rows.withColumnRenamed("fold", "_held") if "fold" in rows.columns else rows
        chosen = decide(renamed.withColumnRenamed("_fold", "fold"), stats.withColumnRenamed("_fold", "fold"), self.getOrDefault("tau"), use_floor=self.getOrDefault("useFloor")).drop("fold")
        return chosen.withColumnRenamed("_held", "fold") if "_held" in chosen.columns else chosen


class RoutedQuality(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Of chosen rows the mean score (``quality``) or the harmonic ratio (``compression``); larger is better."""

    metric = Param(Params._dummy(), "metric", "quality or compression", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metric: str = "quality"):
        super().__init__()
        self._set(metric=metric)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = dataset.agg(F.avg("score").alias("quality"), (F.count("*") / F.sum(1 / F.col("compression"))).alias("compression")).first()
        return row[self.getOrDefault("metric")]

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True
