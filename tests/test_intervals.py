"""Intervals of the whole catalogue: arrays against the distributed metrics, seeds, strata, rare events."""

import numpy as np
import pytest

from plumbline.operators import metrics as M
from plumbline.operators.frame import Frame


def frame(spark, n=400, rate=None, seed=0, weighted=False, digits=None):
    rng = np.random.default_rng(seed)
    s = 1 / (1 + np.exp(-rng.normal(-0.8, 1.2, n)))
    s = s.round(digits) if digits else s
    y = (rng.random(n) < s).astype(float) if rate is None else (np.arange(n) < rate).astype(float)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(s, y, rng.integers(1, 4, n)))]
    df = spark.createDataFrame(rows, "row_id long, s double, y double, w double")
    return Frame.bind(df, weight="w" if weighted else None)


@pytest.mark.parametrize("weighted, digits", [(False, None), (True, 2)])
def test_arrays_equal_frames(spark, weighted, digits):
    f = frame(spark, weighted=weighted, digits=digits)
    t = f.df.orderBy("s", "row_id").toPandas()
    mine = M.local_metrics(*(t[c].to_numpy(float) for c in "syw"), weighted)
    theirs = M.evaluate(f)
    assert list(mine) == list(theirs) == list(M.CATALOGUE)
    for k, v in theirs.items():
        assert mine[k] == pytest.approx(v, rel=1e-6, abs=1e-8), k


def test_intervals(spark):
    f = frame(spark, rate=4, n=150)
    got = {r["metric"]: r for r in M.intervals(f, replicates=40).collect()}
    assert list(got) == list(M.CATALOGUE) and all(np.isfinite([r["value"], r["ci_low"], r["ci_high"]]).all() and r["ci_low"] <= r["ci_high"] for r in got.values())
    again = M.intervals(Frame(f.df.repartition(3), f.weighted), replicates=40).collect()
    assert [(r["ci_low"], r["ci_high"]) for r in again] == [(r["ci_low"], r["ci_high"]) for r in got.values()]
    wide = M.intervals(f, ["log_loss", "intercept"], replicates=40, stratify=False, seed=1).collect()
    assert [r["metric"] for r in wide] == ["log_loss", "intercept"]  # strata fix the number of events: without them intervals are wider
    assert wide[0]["ci_high"] - wide[0]["ci_low"] > got["log_loss"]["ci_high"] - got["log_loss"]["ci_low"]
    with pytest.raises(ValueError):
        M.intervals(f, ["no such metric"])


def test_poisson_sums(spark):
    f = frame(spark, n=2000)
    got = M.bootstrap(f, 300).first()
    point = M.evaluate(f, ["log_loss", "brier"])
    exact = {r["metric"]: r for r in M.intervals(f, ["log_loss", "brier"], replicates=300, stratify=False).collect()}
    for k, v in point.items():
        assert got[f"{k}_low"] < v < got[f"{k}_high"]
        width = exact[k]["ci_high"] - exact[k]["ci_low"]
        assert got[f"{k}_high"] - got[f"{k}_low"] == pytest.approx(width, rel=0.25)
