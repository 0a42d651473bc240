"""Parameters, inverses with buffers, readings, wrapped models, plot data, the portfolio, sessions and recomputation over streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.special import erf_vec
from plumbline.operators import calibrators as C
from plumbline.operators import stages as T
from plumbline.operators.frame import Frame
from plumbline.sources.tables import portfolio
from plumbline.streaming.windows import recomputed, session_scores


@pytest.fixture(scope="module")
def f(spark):
    rng = np.random.default_rng(3)
    s = 1 / (1 + np.exp(-rng.normal(-1, 1.2, 600)))
    y = (rng.random(600) < s**1.2).astype(float)
    return Frame.bind(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, y))], "row_id long, s double, y double"))


def test_parameters(f):
    model = C.Histogram(n_bins=7)
    assert model.get_params() == {"n_bins": 7, "strategy": "mass", "shrinkage": "jeffreys"}
    model.fit(f)
    assert model.set_params(n_bins=5) is model and not model.fitted and model.n_bins == 5
    assert model.clone().get_params() == model.get_params() and model.clone() is not model
    with pytest.raises(ValueError):
        model.set_params(bins=3)
    for kind in (C.Platt, C.Temperature, C.Beta, C.ScalingBinning, C.BBQ, C.Isotonic, C.CenteredIsotonic, C.VennAbers, C.CrossVennAbers, C.ENIR, C.Spline):
        assert kind().clone().get_params() == kind().get_params()
        with pytest.raises(RuntimeError):
            kind().predict(F.lit(0.5))
    row = f.df.limit(3).withColumn("p", C.Platt().fit(f).predict_proba_2d(F.col("s"))).collect()
    assert all(len(r["p"]) == 2 and sum(r["p"]) == pytest.approx(1) for r in row)


def test_inverses_and_readings(spark, f):
    model = T.CalibratedModel(F.col("s"), C.Platt)
    with pytest.raises(RuntimeError):
        model.interval_inverse(0.1, 0.2)
    model.fit(f.df, "y", "row_id").offset_to(delta=0.3).offset_to(delta=-0.1)
    lo, hi = model.interval_inverse(0.1, 0.4, buffer_logit=0.05)
    ends = spark.createDataFrame([(lo,), (hi,)], "s double").select(model.predict(F.col("s")).alias("p")).collect()
    logit = lambda p: math.log(p / (1 - p))
    assert [logit(r["p"]) for r in ends] == pytest.approx([logit(0.1) + 0.05, logit(0.4) - 0.05])
    assert T.interval_to_raw(model, 0.1, 0.4, buffer_logit=0.05) == pytest.approx((lo, hi))
    assert T.interval_to_raw(model, 0.0, 1.0, space="logit") == (-math.inf, math.inf)
    offset = T.LogitOffset(delta=0.3)
    with pytest.raises(RuntimeError):
        offset.interval_inverse(0.1, 0.2)
    offset.fit(f)
    assert offset.interval_inverse(0.2, 0.6, "logit", 0.1) == pytest.approx((logit(0.2) + 0.1 - 0.3, logit(0.6) - 0.1 - 0.3))
    for bad in ((0.5, 0.4, "probability", 0), (0.1, 0.2, "odds", 0), (0.1, 0.2, "probability", -1)):
        with pytest.raises(ValueError):
            offset.interval_inverse(*bad)
    with pytest.raises(C.Unattainable):
        offset.interval_inverse(0.30, 0.31, buffer_logit=1.0)
    with pytest.raises(TypeError):
        T.interval_to_raw(object(), 0, 1)
    said = model.interpret(spark).collect()
    assert {r["method"] for r in said} == {"Platt", "LogitOffset"} and sorted({r["stage"] for r in said}) == [0, 1, 2]
    ensemble = T.CalibratedModel(T.logistic_trainer(["s"], "y"), C.Platt, "cv", cv=3, ensemble=True).fit(f.df, "y", "row_id")
    assert ensemble.interpret(spark).select("stage").distinct().count() == 3
    with pytest.raises(NotImplementedError):
        ensemble.interval_inverse(0.1, 0.2)
    bands = spark.createDataFrame([("A", 0.0, 0.2), ("B", 0.2, 1.0)], "grade string, lo double, hi double")
    raw = T.bands_to_raw(model, bands, space="logit").collect()
    assert raw[0]["raw_lo"] == -math.inf and raw[1]["raw_hi"] == math.inf and raw[0]["raw_hi"] == pytest.approx(raw[1]["raw_lo"])


def test_plot_data_and_attributions(spark, f):
    model = C.Beta().fit(f)
    after = Frame(model.transform(f.df, out="s"))
    both = T.comparison(f, after).collect()
    assert {r["panel"] for r in both} == {"before", "after"} and sum(r["count"] for r in both) == 1200
    widths = T.interval_widths(C.VennAbers().fit(f), f.df).collect()
    assert all(r["p0"] - 1e-12 <= r["p"] <= r["p1"] + 1e-12 and r["width"] >= -1e-12 for r in widths)
    report, _, chosen = T.select(f, {"platt": C.Platt, "histogram": C.Histogram}, cv=3)
    points = T.selection_points(spark, report, chosen).collect()
    assert [r["place"] for r in points] == [0, 1] and sum(r["chosen"] for r in points) == 1 and sum(r["chosen"] for r in report) == 1
    graded = Frame(f.df.withColumn("grade", F.when(F.col("s") > 0.3, "hi").otherwise("lo")))
    assert {r["grade"] for r in T.grade_points(graded).collect()} == {"hi", "lo"}
    told = T.explanation([[0.4, -0.2], [1.0, 0.5]], -1.0, spark=spark)
    assert T.reconstruction_error(T.adjust_attributions(told, model)) < 1e-12


def test_portfolio(spark):
    exact = portfolio(spark, 500, slope=1.0, asymmetry=0.0)
    assert exact.where("s <> p_true").count() == 0
    shifted = portfolio(spark, 4000, intercept=0.5)
    assert shifted.agg(F.avg("p_true")).first()[0] == pytest.approx(0.03, abs=1e-9)
    z = shifted.selectExpr("ln(p_true) - ln(1 - p_true) - 0.7 * 1.4 * ln(s) + 0.7 * ln(1 - s) AS c").agg(F.min("c"), F.max("c")).first()
    assert z[0] == pytest.approx(z[1], abs=1e-8)  # the exponents are slope (1 + asymmetry) below and slope above
    with pytest.raises(ValueError):
        portfolio(spark, 10, event_rate=1.0)
    assert erf_vec([0.0, 1.0]) == pytest.approx([0.0, 0.8427007929497149])


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", "u", 0.2 + 0.1 * (i % 3), float(i % 2)) for i, m in enumerate((0, 5, 9, 50, 55))]
    df = spark.createDataFrame(rows, "row_id long, t string, user string, s double, y double").select("*", F.to_timestamp("t").alias("ts")).drop("t")
    got = sorted(tuple(r) for r in session_scores(df, by=("user",)).select("n", "user").collect())
    assert got == [(2, "u"), (3, "u")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = recomputed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda whole, k: seen.append((k, whole.count())), str(tmp_path / "ck"), str(tmp_path / "history"))
    query.processAllAvailable()
    df.withColumn("row_id", F.col("row_id") + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, 5), (1, 10)]
