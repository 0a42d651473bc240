"""Calibration maps in a pipeline of ``pyspark.ml``."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.operators import calibrators as C
from plumbline.operators.frame import Frame
from plumbline.operators.ml import CalibratorEstimator


def test_pipeline(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] - 0.5)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), 1.0 + (i % 2)) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, label double, w double")
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(maxIter=10), CalibratorEstimator(C.Platt, scoreCol="probability", predictionCol="p", weightCol="w")]
    out = Pipeline(stages=stages).fit(df).transform(df)
    got = out.select("p").toPandas()["p"]
    assert got.between(0, 1).all() and out.count() == 400
    plain = out.select(F.expr("1.0 * prediction").alias("unused"), "label", "w", F.udf(lambda v: float(v[1]), "double")("probability").alias("s"), F.monotonically_increasing_id().alias("row_id"))
    model = C.Platt().fit(Frame.bind(plain, "s", "label", "w"))
    assert np.allclose(sorted(got), sorted(model.transform(plain).toPandas()["p"]))
    again = CalibratorEstimator(scoreCol="s").fit(plain).transform(plain)
    assert "calibrated" in again.columns
