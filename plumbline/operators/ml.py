"""Calibration maps as stages of a ``pyspark.ml`` pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clipped
from ..session import ship
from .calibrators import Calibrator, Platt
from .frame import Frame


class _Columns(Params):
    scoreCol = Param(Params._dummy(), "scoreCol", "probabilities, or vectors or arrays of both outcomes' probabilities", typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "outcomes, 0 or 1", typeConverter=TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "positive weights; none if not set", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "calibrated probabilities", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(scoreCol="score", labelCol="label", predictionCol="calibrated")

    def _score(self, df: DataFrame):
        name = self.getOrDefault(self.scoreCol)
        kind = df.schema[name].dataType.typeName()
        if kind == "array":
            return F.col(name)[1].cast("double")
        if kind in ("vector", "vectorudt", "udt"):
            from pyspark.ml.functions import vector_to_array

            return vector_to_array(F.col(name))[1]
        return F.col(name).cast("double")


class CalibratorEstimator(Estimator, _Columns):
    """Fits a calibration map on the score, label and weight columns; ``make`` gives an unfitted map."""

    def __init__(self, make: Callable[[], Calibrator] = Platt, **columns: str):
        super().__init__()
        self.make = make
        self._set(**columns)

    def _fit(self, dataset: DataFrame) -> CalibratorModel:
        weight = self.getOrDefault(self.weightCol) if self.isSet(self.weightCol) else None
        rows = dataset.select(self._score(dataset).alias("_score"), F.col(self.getOrDefault(self.labelCol)).alias("_label"), *([F.col(weight).alias("_weight")] if weight else []), F.monotonically_increasing_id().alias("row_id"))
        model = CalibratorModel(self.make().fit(Frame.bind(rows, "_score", "_label", "_weight" if weight else None)))
        return self._copyValues(model)


class CalibratorModel(Model, _Columns):
    """A fitted map; adds the prediction column."""

    def __init__(self, calibrator: Calibrator):
        super().__init__()
        self.calibrator = calibrator

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        return dataset.withColumn(self.getOrDefault(self.predictionCol), self.calibrator.predict(clipped(self._score(dataset))))
