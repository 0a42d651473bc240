"""Queries over unrounded scores, against brute force over the smallest table."""

import math

import numpy as np
import pytest

from plumbline.plans import catalogue
from plumbline.sources.tables import orders_frame

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    t = orders_frame(spark, DATA).toPandas().sort_values("s", kind="stable")
    assert t["s"].round(2).nunique() < 101 < 1000 < t["s"].nunique()
    g = t.assign(wy=t.w * t.y, n=1).groupby("s", as_index=False)[["w", "wy", "n"]].sum()
    return t, g


def rows(spark, name):
    return {r["row_id"]: r["p"] for r in catalogue.queries()[name](spark, DATA).collect()}


def one(spark, name):
    return catalogue.queries()[name](spark, DATA).first().asDict()


def by_row(t, s, fit):
    return dict(zip(t.row_id, fit[np.searchsorted(s, t.s)]))


def minimax(g):
    """Isotonic fit: the largest over starts of the least mean over ends."""
    w, wy = np.r_[0, np.cumsum(g.w)], np.r_[0, np.cumsum(g.wy)]
    n = len(g)
    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    mean = np.where(b >= a, (wy[1:][None] - wy[:-1][:, None]) / np.where(b >= a, w[1:][None] - w[:-1][:, None], 1), np.inf)
    low = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]  # least mean from a to any end not before i
    return np.array([low[: i + 1, i].max() for i in range(n)])


def knots(g, fit, kind):
    out = []
    for v in np.unique(fit.round(12)):
        part = g[np.abs(fit - v) < 1e-10]
        out.append(((part.s.iloc[0] + part.s.iloc[-1]) / 2 if kind == "middle" else np.average(part.s, weights=part.w), v))
    return np.array(out).T


def loess_at(t, x0, r):
    x, y = t.s.to_numpy(), t.y.to_numpy()
    h = max((max(x0 - x[i], x[i + r - 1] - x0), i) for i in [min(range(len(x) - r + 1), key=lambda i: (max(x0 - x[i], x[i + r - 1] - x0), i))])[0]
    k = np.clip(1 - (np.abs(x - x0) / h) ** 3, 0, None) ** 3
    return np.polynomial.polynomial.polyfit(x - x0, y, 1, w=np.sqrt(k))[0]


def enir(g):
    """The path step by step on lists, every fit scored."""
    mean, weight, member = list(g.wy / g.w), list(g.w), [[k] for k in range(len(g))]
    w, wy, path = g.w.to_numpy(), g.wy.to_numpy(), []
    while True:
        fit = np.empty(len(g))
        for m, at in zip(mean, member):
            fit[at] = m
        q = np.clip(fit, 1e-12, 1 - 1e-12)
        path.append((-2 * (wy @ np.log(q) + (w - wy) @ np.log1p(-q)) + (1 + (np.abs(np.diff(fit)) > 1e-12).sum()) * math.log(w.sum()), fit))
        m, u = np.array(mean), np.array(weight)
        viol = m[:-1] > m[1:] + 1e-15
        if not viol.any():
            break
        slope = (np.r_[0, viol] * 1.0 - np.r_[viol, 0] * 1.0) / u
        gap, speed = np.diff(m), np.diff(slope)
        when = np.array([-a / b if a * b < 0 else np.inf for a, b in zip(gap, speed)])
        k = int(when.argmin())
        m = m + slope * when[k]
        mean = [*m[:k], (m[k] * u[k] + m[k + 1] * u[k + 1]) / (u[k] + u[k + 1]), *m[k + 2 :]]
        weight = [*u[:k], u[k] + u[k + 1], *u[k + 2 :]]
        member[k : k + 2] = [member[k] + member[k + 1]]
    path = sorted(path, key=lambda x: x[0])[:256]
    share = np.exp(-(np.array([x[0] for x in path]) - path[0][0]) / 2)
    return np.clip((share / share.sum()) @ np.array([x[1] for x in path]), 1e-12, 1 - 1e-12)


def test_enir(spark, data):
    t, g = data
    assert rows(spark, "enir") == pytest.approx(by_row(t, g.s.to_numpy(), enir(g)), abs=2e-6)


def test_isotonic(spark, data):
    t, g = data
    fit, s = minimax(g), g.s.to_numpy()
    assert rows(spark, "isotonic") == pytest.approx(by_row(t, s, fit), abs=2e-6)
    for name, kind in (("isotonic_linear", "middle"), ("cir", "centre")):
        assert rows(spark, name) == pytest.approx(by_row(t, s, np.interp(s, *knots(g, fit, kind))), abs=2e-6)
    assert one(spark, "isotonic_interval_inverse") == pytest.approx({"raw_lo": s[fit >= 0.2 - 1e-12][0], "raw_hi": s[fit > 0.3 + 1e-12][0]}, abs=2e-6)


def test_bbq_and_sweep(spark, data):
    t, g = data
    s, total, fits = g.s.to_numpy(), [], []
    for b in range(2, 51):
        at = np.searchsorted(np.unique(np.quantile(t.s, np.arange(1, b) / b)), s, "right")
        n, k = np.bincount(at, g.w), np.bincount(at, g.wy)
        total.append(sum(math.lgamma(x + 0.5) + math.lgamma(m - x + 0.5) - math.lgamma(m + 1) - math.log(math.pi) for x, m in zip(k, n)))
        fits.append(((k + 0.5) / (n + 1))[at])
    share = np.exp(np.array(total) - max(total))
    assert rows(spark, "bbq") == pytest.approx(by_row(t, s, (share / share.sum()) @ np.array(fits)), abs=1e-5)
    best = None
    for b in range(1, 101):
        at = np.searchsorted(np.unique(np.quantile(t.s, np.arange(1, b) / b)), s, "right") if b > 1 else np.zeros(len(s), int)
        n, k, p = np.bincount(at, g.w), np.bincount(at, g.wy), np.bincount(at, g.w * s)
        if (np.diff(k / n) >= 0).all():
            best = {"ece": np.abs(p - k).sum() / n.sum(), "bins": b}
    assert one(spark, "ece_sweep") == pytest.approx(best, abs=2e-6)


def test_local_regression(spark, data):
    t, g = data
    r = math.ceil(0.75 * len(t))
    fit = np.array([loess_at(t, x, r) for x in g.s])
    s, w = g.s.to_numpy(), g.w.to_numpy()
    assert one(spark, "ici_family") == pytest.approx({"ici": np.average(np.abs(fit - s), weights=w), "emax": np.abs(fit - s).max()}, abs=2e-6)
    c = np.clip(fit, 1e-12, 1 - 1e-12)
    want = {"calibration": np.average(c * np.log(c / s) + (1 - c) * np.log((1 - c) / (1 - s)), weights=w), "refinement": np.average(-(c * np.log(c) + (1 - c) * np.log1p(-c)), weights=w)}
    assert one(spark, "logloss_decomposition") == pytest.approx(want, abs=2e-6)


def _loess_by_rows(x, y, at, r):
    """Row by row; not a number where the line is so badly determined that rounding decides."""
    out = []
    for x0 in at:
        i = 0
        while i < len(x) - r and x[i + r] + x[i] < 2 * x0:  # the row after the window is nearer than its first one
            i += 1
        h = max(x0 - x[i], x[i + r - 1] - x0)
        d = x[i : i + r] - x0
        if h <= 0:
            out.append(y[i : i + r].mean())
            continue
        w = np.where(np.abs(d) < h * (1 - 1e-12), np.clip(1 - (np.abs(d) / h) ** 3, 0, None) ** 3, 0.0)
        if not w.any():  # one score, not at the place
            out.append(y[i : i + r].mean())
            continue
        s0, s1, s2, sy, sxy = w.sum(), w @ d, w @ (d * d), w @ y[i : i + r], w @ (d * y[i : i + r])
        det = s0 * s2 - s1 * s1
        out.append(sy / s0 if len(np.unique(x[i : i + r][w > 0])) == 1 else (s2 * sy - s1 * sxy) / det if det > 1e-6 * s0 * s2 else np.nan)
    return np.array(out)


@pytest.mark.parametrize("kind", ["ties", "spread", "clumps", "tails"])
@pytest.mark.parametrize("frac", [0.1, 0.75, 1.0])
def test_loess_by_moments(kind, frac):
    from plumbline.operators.solvers import loess, repeated_quantiles

    rng = np.random.default_rng(7)
    x = {"ties": rng.integers(1, 12, 300) / 12, "spread": rng.random(300), "clumps": np.r_[0.3 + 1e-4 * rng.random(140), 0.7 + 1e-5 * rng.random(140), rng.random(20)], "tails": 1 / (1 + np.exp(-rng.normal(0, 5, 300)))}[kind]
    x = np.sort(x)
    y = (rng.random(300) < x).astype(float)
    s, n = np.unique(x, return_counts=True)
    k = np.array([y[x == v].sum() for v in s])
    pooled = np.repeat(k / n, n)
    at = np.r_[s, np.linspace(0, 1, 21)]
    r = math.ceil(frac * 300)
    want = _loess_by_rows(x, pooled, at, r)
    sure = ~np.isnan(want)
    assert sure.mean() > 0.9 and loess(s, n.astype(float), k, at, frac)[sure] == pytest.approx(want[sure], abs=1e-6)
    assert repeated_quantiles(s, n.astype(float), [0, 0.1, 0.5, 0.93, 1]) == pytest.approx(np.quantile(x, [0, 0.1, 0.5, 0.93, 1]), abs=1e-12)


def test_quantiles_over_ranges(spark):
    from plumbline.operators.frame import Frame

    rng = np.random.default_rng(8)
    for x in (rng.random(500), np.repeat([0.2, 0.4, 0.4 + 1e-9], [300, 1, 200]), np.full(50, 0.3), np.r_[0.5 + 1e-7 * rng.random(400), 0.9]):
        f = Frame.bind(spark.createDataFrame([(i, float(v), float(i % 2)) for i, v in enumerate(x)], "row_id long, s double, y double"))
        levels = [k / b for b in (3, 10, 7) for k in range(1, b)]
        assert f.quantiles(levels) == pytest.approx(np.quantile(x, levels), rel=1e-12)
