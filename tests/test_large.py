"""Operators past the sizes that one machine holds: small bounds stand for large tables, results against one pass over all rows."""

import time

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from plumbline.operators import calibrators as C
from plumbline.operators import frame, kernel, local_regression
from plumbline.operators import metrics as M
from plumbline.operators.frame import Frame
from plumbline.plans import catalogue


def drawn(spark, rows, digits=None, seed=3):
    """A frame of random scores, outcomes and weights, and the same in the order of (s, row_id)."""
    rng = np.random.default_rng(seed)
    t = pd.DataFrame({"row_id": np.arange(rows), "s": rng.uniform(0.02, 0.98, rows), "w": rng.integers(1, 5, rows).astype(float)})
    if digits:
        t["s"] = t["s"].round(digits)
    t["y"] = (rng.uniform(size=rows) < t["s"] ** 1.3).astype(float)
    return Frame(spark.createDataFrame(t), True), t.sort_values(["s", "row_id"]).reset_index(drop=True)


@pytest.mark.parametrize("digits", [None, 1])
def test_venn_abers_over_ranges(spark, monkeypatch, digits):
    monkeypatch.setattr(C, "MAX_POINTS", 400)
    monkeypatch.setattr(C, "RANGE_ROWS", 90, raising=False)
    f, t = drawn(spark, 1500, digits)
    c, z = np.r_[0, np.cumsum(t.w)].tolist(), np.r_[0, np.cumsum(t.w * t.y)].tolist()
    at = np.r_[0.0, np.linspace(0.01, 0.99, 60), t.s, 1.0]
    k = np.searchsorted(t.s, at, "left")
    m = C.VennAbers().fit(f)
    for got, label in zip(m.interval(at), (0.0, 1.0)):
        assert got == pytest.approx(np.array(C._inserted(c, z, label))[k], abs=1e-12)
    assert m.rows.sum() == 1500
    lo, hi = m.interval(t.s.to_numpy())
    assert m.parameters()["mean_width"] == pytest.approx((hi - lo).mean(), abs=1e-12)


def test_cross_venn_abers_over_ranges(spark, monkeypatch):
    f, t = drawn(spark, 1500)
    whole = C.CrossVennAbers().fit(f)
    monkeypatch.setattr(C, "MAX_POINTS", 400)
    monkeypatch.setattr(C, "RANGE_ROWS", 90, raising=False)
    got = C.CrossVennAbers().fit(f)
    assert got.local(t.s.to_numpy()) == pytest.approx(whole.local(t.s.to_numpy()), abs=1e-12)


#: What the local regression gives, by name.
ASKED = {
    "ici_family": lambda f: M.ici_family(f, grid=None),
    "evaluate": lambda f: M.evaluate(f, ["ici", "e50", "e90", "emax"]),
    "logloss": M.logloss_decomposition,
    "summary": lambda f: {k: v for k, v in M.reliability_summary(f).items() if k in ("ici", "e90")},
    "quantiles": lambda f: M.ici_family(f, grid=64),
    "curve": lambda f: dict(M.reliability_loess(f)),
}


@pytest.mark.parametrize("digits", [None, 2])
@pytest.mark.parametrize("name", ASKED)
def test_local_regression_past_one_machine(spark, monkeypatch, name, digits):
    """Results of the local regression without all distinct scores on the driver are those with them."""
    weighted, _ = drawn(spark, 1500, digits)
    frames = [weighted, Frame(weighted.df.withColumn("w", F.lit(1.0)))]
    near = [ASKED[name](f) for f in frames]
    monkeypatch.setattr(frame, "MAX_POINTS", 50)
    monkeypatch.setattr(local_regression, "RANGE_SCORES", 40 if digits else 500)
    for f, due in zip(frames, near):
        got = ASKED[name](f)
        assert list(got) == (pytest.approx(list(due), abs=1e-12) if name == "curve" else list(due))
        assert list(got.values()) == pytest.approx(list(due.values()), abs=1e-9)


def test_spline_past_one_machine(spark, monkeypatch):
    f, t = drawn(spark, 1500)
    near = C.Spline().fit(f)
    monkeypatch.setattr(C, "MAX_POINTS", 400)
    monkeypatch.setattr(C, "SPLINE_PAIRS", 400, raising=False)
    got = C.Spline().fit(f)
    assert got.parameters() == pytest.approx(near.parameters(), rel=1e-8) and got.monotone == near.monotone
    assert got.local(t.s.to_numpy()) == pytest.approx(near.local(t.s.to_numpy()), abs=1e-9)


def test_enir_time_and_path():
    """A walk by a heap: 60,000 scores in seconds; borders and penalties of a small path as known by hand."""

    class Held:
        def pooled(self):
            rng = np.random.default_rng(5)
            s, w = np.sort(rng.uniform(0.02, 0.98, 60_000)), rng.uniform(0.2, 5, 60_000)
            return {"s": s, "w": w, "wy": w * (rng.uniform(size=len(s)) < s)}

    began = time.process_time()
    m = C.ENIR()
    m._fit(Held())
    assert time.process_time() - began < 20
    assert m.weights.sum() == pytest.approx(1) and np.all(np.diff(m.values) > -0.02)
    gone, since, lambdas = C._near_isotonic(np.array([2.0, 0.0, 1.0, 1.0, 0.0]), np.array([2.0, 2.0, 1.0, 2.0, 1.0]))
    # means 1, 0, 1, 1/2, 0: the third falls to the fourth and the fifth rises to it at 1/2, the first two meet at 1, and no fall is left
    assert gone.tolist() == [3, 5, 1, 2] and since.tolist() == [0, np.inf, 0, 0] and lambdas.tolist() == pytest.approx([0, 0.5, 0.5, 1])


@pytest.mark.parametrize("digits, blocks", [(None, 2000), (None, 300), (3, 100)])
def test_enir_past_one_machine(spark, monkeypatch, digits, blocks):
    """The start of the path in ranges leaves the fits as they are; with few blocks left, the driver has to begin sooner."""
    f, t = drawn(spark, 20_000, digits)
    near = C.ENIR().fit(f)
    monkeypatch.setattr(frame, "MAX_POINTS", 400)
    for name, value in (("PATH_SCORES", 400), ("PATH_BLOCKS", blocks), ("RANGE_ROWS", 300 if digits else 3000)):
        monkeypatch.setattr(C, name, value, raising=False)
    got = C.ENIR().fit(f)
    assert got.local(t.s.to_numpy()) == pytest.approx(near.local(t.s.to_numpy()), abs=1e-9)
    assert got.lambdas[0] == pytest.approx(near.lambdas[0]) and got.weights[0] == pytest.approx(near.weights[0]) and len(got.values) < len(near.values)


def test_enir_of_rising_outcomes_past_one_machine(spark, monkeypatch):
    """No fit but the outcomes themselves, whose equal neighbours are one step."""
    f, t = drawn(spark, 5000)
    monkeypatch.setattr(frame, "MAX_POINTS", 400)
    for name, value in (("MAX_POINTS", 4000), ("PATH_SCORES", 400), ("PATH_BLOCKS", 200), ("RANGE_ROWS", 800)):
        monkeypatch.setattr(C, name, value, raising=False)
    got = C.ENIR().fit(Frame(f.df.withColumn("y", (F.col("s") > 0.5).cast("double")), True))
    assert got.local(t.s.to_numpy()) == pytest.approx((t.s > 0.5).to_numpy(float), abs=1e-9) and got.lambdas == [0.0] and len(got.values) < 50


@pytest.mark.parametrize("digits", [None, 2])
@pytest.mark.parametrize("bend", [1.0, 1.3])
def test_bootstrap_test_past_one_machine(spark, monkeypatch, digits, bend):
    """The statistic of the whole, and resamples alike in law, whether the classes are on the driver or in ranges."""
    f, _ = drawn(spark, 1500, digits)
    if bend == 1.0:  # calibrated outcomes
        f = Frame(f.df.withColumn("y", (F.rand(4) < F.col("s")).cast("double")).localCheckpoint())
    width = kernel.bandwidth_of(f)
    ask = (F.col("s"), "laplace", 10**6, width, 4000, 42)
    due, near = kernel._resampled_near(f, *ask)
    monkeypatch.setattr(kernel, "RANGE_CLASSES", 150)
    got, far = kernel._resampled_far(f, F.col("s"), 1000, width, 4000, 42)
    assert got == pytest.approx(due, abs=1e-12)
    assert far.mean() == pytest.approx(near.mean(), abs=0.1 * near.std())
    assert np.quantile(far, [0.1, 0.5, 0.9]) == pytest.approx(np.quantile(near, [0.1, 0.5, 0.9]), abs=0.2 * near.std())
    monkeypatch.setattr(kernel, "TEST_CLASSES", 100)
    assert M.skce_test(f, replicates=199)["statistic"] == pytest.approx(due, abs=1e-12)


def test_reliability_spline_past_one_machine(spark, monkeypatch):
    ask = lambda: {r["grid_p"]: r["event_rate"] for r in catalogue.queries()["reliability_spline"](spark, "/root/testdata/sf0.001").collect()}
    near = ask()
    monkeypatch.setattr(C, "MAX_POINTS", 400)
    monkeypatch.setattr(C, "SPLINE_PAIRS", 400, raising=False)
    assert ask() == pytest.approx(near, abs=1.1e-6)
