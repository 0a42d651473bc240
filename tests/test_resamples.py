"""Resamples drawn range by range: each one's metrics are those of its rows as arrays, and intervals agree with those of one machine."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import metrics as M
from plumbline.operators import resamples as R
from plumbline.operators.frame import Frame


def frame(spark, rows=3000, digits=None, weighted=True, bend=1.3, far=False, seed=3):
    rng = np.random.default_rng(seed)
    t = pd.DataFrame({"row_id": np.arange(rows), "s": rng.uniform(0.06, 0.94, rows), "w": rng.integers(1, 5, rows).astype(float) if weighted else 1.0})
    if digits:
        t["s"] = t["s"].round(digits)
    if far:
        t.loc[:1, "s"] = [1e-9, 1 - 1e-9]
    t["y"] = (rng.uniform(size=rows) < t["s"] ** bend).astype(float)
    return Frame(spark.createDataFrame(t), weighted)


CASES = [({}, True), ({"digits": 2}, False), ({"digits": 1, "weighted": False}, True), ({"rows": 20_000, "bend": 1.0}, False), ({"rows": 20_000, "bend": 1.0, "far": True, "weighted": False}, True)]


@pytest.mark.parametrize("options, stratify", CASES, ids=str)
def test_resamples_over_ranges(spark, monkeypatch, options, stratify):
    monkeypatch.setattr(R, "RANGE_ROWS", options.get("rows", 3000) // 9)
    f = frame(spark, **options)
    count = f.df.count()
    got = R.resampled(f, count, M.CATALOGUE, 3, 42, stratify)
    r = R.Resamples(f, count, 42, stratify)
    drawn = r.run(range(3), {"rows": lambda t, i, c, g: np.repeat(np.stack([t.s, t.y, t.w]), c.astype(int), axis=1).T.ravel()}, {"shares": r.shares(range(3))})["rows"]
    r.done()
    assert len(r.parts) > 5
    for i, own in enumerate(drawn):
        s, y, w = np.concatenate([a.reshape(-1, 3) for _, a in own]).T
        assert len(s) == count and (np.diff(s) >= 0).all()
        due = M.local_metrics(s, y, w, f.weighted)
        assert dict(zip(M.CATALOGUE, got[i])) == pytest.approx(due, rel=1e-7, abs=1e-9)


def test_intervals_past_one_machine(spark, monkeypatch):
    f = frame(spark)
    names = ["log_loss", "ece_sweep", "ici", "e90", "slope"]
    near = {r["metric"]: r for r in M.intervals(f, names, replicates=300).collect()}
    monkeypatch.setattr(M, "MAX_POINTS", 1000)
    monkeypatch.setattr(R, "RANGE_ROWS", 400)
    monkeypatch.setattr(R, "GROUP", 200)
    far = M.intervals(f, names, replicates=300).collect()
    assert [r["metric"] for r in far] == names
    for r in far:
        due = near[r["metric"]]
        assert r["value"] == pytest.approx(due["value"], rel=1e-12)
        assert [r["ci_low"], r["ci_high"]] == pytest.approx([due["ci_low"], due["ci_high"]], abs=0.2 * (due["ci_high"] - due["ci_low"]))


def test_resamples_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 400)
    f, names = frame(spark), ["log_loss", "ecce_mean", "emax"]
    got = [R.resampled(Frame(df, True), 3000, names, 3, 42, True) for df in (f.df, f.df.repartition(7))]
    assert got[1] == pytest.approx(got[0], rel=1e-12)
