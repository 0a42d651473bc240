"""Smooth ECE over more distinct scores than cells, against a direct sum over every score."""

import math

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import metrics as M
from plumbline.operators.frame import Frame


def brute(s, y):
    """The fixed point on a fine grid over the logits, without a lattice."""
    z, m = np.log(s) - np.log1p(-s), (y - s) / len(s)
    order = np.argsort(z)
    z, m = z[order], m[order]

    def at(sigma):
        grid = np.arange(z[0] - 5 * sigma, z[-1] + 5 * sigma, sigma / 8)
        out = np.zeros(len(grid))
        first, last = np.searchsorted(z, grid - 6 * sigma), np.searchsorted(z, grid + 6 * sigma)
        for k in np.flatnonzero(last > first):
            a, b = first[k], last[k]
            out[k] = np.exp(-0.5 * ((grid[k] - z[a:b]) / sigma) ** 2) @ m[a:b]
        return float(np.abs(out).sum() * sigma / 8 / (sigma * math.sqrt(2 * math.pi)))

    low, high = 1e-4, 2.0
    while high - low >= 1e-4:
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) > mid else (low, mid)
    return (low + high) / 2


@pytest.mark.parametrize("far", [1.5, 6.0])
def test_calibrated_scores_with_extremes(spark, far):
    """The bandwidth is far below the logit range over 256: the points of a grid over that range would miss the masses."""
    rng, n = np.random.default_rng(7), 120_000
    s = 1 / (1 + np.exp(-np.r_[-far, rng.uniform(-0.05, 0.05, n), far]))
    y = np.r_[0.0, (rng.random(n) < s[1:-1]).astype(float), 1.0]
    f = Frame.bind(spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n + 2), "s": s, "y": y})))
    want = brute(s, y)
    assert want > 1e-3
    assert M.smooth_ece(f) == pytest.approx(want, abs=2e-4)


def test_lattice_keeps_isolated_masses():
    m = np.array([0.1, -0.2, 0.3])
    assert M._smoothed_lattice(m, 1.0, 1e-3) == pytest.approx(0.6)
    assert M._fixed_point(lambda sigma: 3e-5) == 3e-5
