"""Iterative fits as driver loops over small aggregates, pool-adjacent-violators in two steps, local regression."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import expit, softplus


#: Fits and metrics that don't need each other are submitted from this many driver threads.
SIDE_BY_SIDE = 4


def together(work: Sequence[Callable[[], object]]) -> list:
    """Results of independent pieces of driver work, in order; their small jobs run side by side instead of one after another."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


@dataclass
class Logistic:
    """Coefficients, loss and Hessian of a logistic fit."""

    beta: list[float]
    loss: float
    hessian: np.ndarray
    converged: bool
    separation: bool


def irls(df: DataFrame, features: Sequence[Column], y: Column, w: Column, offset: Column | None = None, ridge: float = 0.0, rounds: int = 50, tol: float = 1e-10) -> Logistic:
    """Logistic regression by Newton steps; a step is one aggregate of the loss, gradient and Hessian.

    A step that raises the loss is halved. Outcomes that the features separate (all margins beyond 10 while the
    gradient is not yet zero, a singular Hessian, or no convergence) are fitted again with a ridge of 1e-6."""
    k = len(features)
    base = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(features)], y.alias("y"), w.alias("w"), (offset if offset is not None else F.lit(0.0)).alias("o"))
    x = [F.col(f"x{i}") for i in range(k)]

    def sums(beta: np.ndarray):
        part = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        eta = part + F.col("o")
        mu = expit(eta)
        slack, curve = F.col("w") * (F.col("y") - mu), F.col("w") * mu * (1 - mu)
        cells = [F.sum(slack * c) for c in x] + [F.sum(curve * x[i] * x[j]) for i in range(k) for j in range(i + 1)]
        got = base.agg(F.sum(F.col("w") * (softplus(eta) - F.col("y") * eta)), F.min(F.when(F.col("y") > 0.5, part).otherwise(-part)), F.min((F.col("y") == 0) | (F.col("y") == 1)), *cells).first()
        hessian = np.zeros((k, k))
        hessian[np.tril_indices(k)] = got[3 + k :]
        hessian = hessian + np.tril(hessian, -1).T + ridge * np.eye(k)
        return got[0] + ridge * float(beta @ beta) / 2, np.array(got[3 : 3 + k]) - ridge * beta, hessian, got[1], got[2]

    beta = np.zeros(k)
    loss, gradient, hessian, margin, binary = sums(beta)
    converged = separation = False
    for _ in range(rounds):
        if binary and not ridge and margin > 10 and np.abs(gradient).max() > 1e-8 * (1 + abs(loss)):
            separation = True
            break
        try:
            step = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError:
            separation = bool(binary)
            break
        for _ in range(30):
            after = sums(beta + step)
            if after[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        else:
            converged = np.abs(gradient).max() < 1e-6 * (1 + abs(loss))
            break
        beta = beta + step
        loss, gradient, hessian, margin, binary = after
        if np.abs(step).max() < tol * (1 + np.abs(beta).max()):
            converged = True
            break
    if (separation or not converged) and not ridge and binary:
        warnings.warn("the outcomes are (nearly) separated by the features; fitted again with a small ridge", stacklevel=2)
        again = irls(df, features, y, w, offset, 1e-6, rounds, tol)
        return Logistic(again.beta, again.loss, again.hessian, again.converged, True)
    return Logistic([float(b) for b in beta], loss, hessian, converged, separation)


def root_1d(values, start: float, low: float, high: float, tol: float = 1e-13) -> float:
    """Zero of an increasing function: ``values(x)`` gives it and its slope (one job); Newton steps kept in a bracket."""
    x = start
    for _ in range(100):
        f, slope = values(x)
        if f == 0:
            return x
        low, high = (x, high) if f < 0 else (low, x)
        after = x - f / slope if slope > 0 else (low + high) / 2
        if not low < after < high:
            after = (low + high) / 2
        if abs(after - x) <= tol * (1 + abs(x)):
            return after
        x = after
    return x


def pava(first: np.ndarray, last: np.ndarray, weight: np.ndarray, total: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Blocks (first, last, weight, weighted outcome, weighted score) merged while a block's mean is above the next one's."""
    out: list[list[float]] = []
    for row in zip(first, last, weight, total, moment):
        out.append(list(row))
        while len(out) > 1 and out[-2][3] * out[-1][2] > out[-1][3] * out[-2][2]:
            b = out.pop()
            a = out[-1]
            out[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4]]
    return np.array(out).reshape(-1, 5)


def isotonic_blocks(df: DataFrame) -> np.ndarray:
    """Isotonic blocks of (s, y, w): ties pooled, blocks merged within range partitions, then over their borders.

    Merging is associative over ordered blocks, so the two steps equal one pass; only blocks reach the driver."""
    pooled = df.groupBy("s").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = pooled.repartitionByRange(parts, "s").sortWithinPartitions("s")

    def run(batches):
        import pandas as pd

        t = pd.concat(list(batches) or [pd.DataFrame({"s": [], "w": [], "wy": []})])
        b = pava(t["s"].to_numpy(), t["s"].to_numpy(), t["w"].to_numpy(), t["wy"].to_numpy(), (t["w"] * t["s"]).to_numpy())
        yield pd.DataFrame(b, columns=["first", "last", "w", "wy", "ws"])

    got = ranged.mapInPandas(run, "first double, last double, w double, wy double, ws double").orderBy("first").toPandas().to_numpy(float)
    return pava(*got.T) if len(got) else got


def repeated_quantiles(x: np.ndarray, counts: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """Quantiles of values that stand for several rows each, linear between neighbouring rows."""
    order = np.argsort(x, kind="stable")
    x, upto = x[order], np.cumsum(counts[order])
    at = np.asarray(levels, float) * (upto[-1] - 1)
    low, high = (x[np.minimum(np.searchsorted(upto, r, "right"), len(x) - 1)] for r in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


#: The tricube weight (1 - u^3)^3 by powers of u.
_TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))


def loess(x: np.ndarray, n: np.ndarray, k: np.ndarray, at: np.ndarray, frac: float = 0.75, degree: int = 1, grid: int | None = None, weights_of: np.ndarray | None = None) -> np.ndarray:
    """Local regression of outcomes on scores: distinct scores in order, rows and events of each; tricube weights over the nearest
    share of the rows, the leftmost window of least width. Rows of one score have its event rate.

    Over more than ``grid`` places only that many quantiles are fitted, and the rest interpolated. On each side of a place the
    weight is a polynomial in the distance, so its sums come from prefix sums of powers about a centre nearby: the cost is that
    of the scores, not of scores times places."""
    rows = float(n.sum())
    r = min(max(np.ceil(frac * rows), degree + 1), rows)
    if grid and (len(at) if weights_of is None else weights_of.sum()) > grid:
        levels = np.linspace(0, 1, grid)
        anchors = np.unique(np.quantile(at, levels) if weights_of is None else repeated_quantiles(at, weights_of, levels))
        return np.interp(at, anchors, loess(x, n, k, anchors, frac, degree))
    upto = np.cumsum(n)
    row = lambda i: x[np.minimum(np.searchsorted(upto, i, "right"), len(x) - 1)]
    # the window from row i ends at i + r - 1; it moves right while the score after it is nearer than its first one
    steps = np.unique(np.r_[0.0, upto, upto - r])
    steps = steps[(steps >= 0) & (steps < rows - r)]
    first = np.zeros(len(at)) if not len(steps) else np.r_[steps, rows - r][np.searchsorted(row(steps) + row(steps + r), 2 * at, "left")]
    lo, hi = np.searchsorted(upto, first, "right"), np.searchsorted(upto, first + r - 1, "right")
    hi = np.minimum(hi, len(x) - 1)
    h = np.maximum(at - x[lo], x[hi] - at)

    def powers(a: int, b: int, centre: float, scale: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        u = (x[a:b] - centre) / scale
        power = np.ones_like(u)
        sums_n, sums_k = [], []
        for _ in range(12):
            sums_n.append(np.r_[0.0, np.cumsum(n[a:b] * power)])
            sums_k.append(np.r_[0.0, np.cumsum(k[a:b] * power)])
            power = power * u
        return sums_n, sums_k

    return local_fits(x, n, k, powers, lo, hi, at, h, degree)


def local_fits(x: np.ndarray, n: np.ndarray, k: np.ndarray, powers: Callable, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, h: np.ndarray, degree: int) -> np.ndarray:
    """Fits at places with windows of half width ``h``, from ``lo`` to ``hi`` of ``x``; ``powers`` gives prefix sums of powers about a centre."""
    out = np.empty(len(at))
    for j in np.flatnonzero(h <= 0):
        part = slice(lo[j], hi[j] + 1)
        out[j] = k[part].sum() / n[part].sum()
    todo = np.flatnonzero(h > 0)
    todo = todo[np.argsort(at[todo], kind="stable")]
    start = 0
    while start < len(todo):
        centre = at[todo[start]] + h[todo[start]] / 2
        rest, own = at[todo[start:]], h[todo[start:]]
        end = start + int(np.argmax(np.r_[(np.abs(rest - centre) > own / 2 * (1 + 1e-9)) | (own > 2 * own[0]) | (own < own[0] / 2), True]))
        mine = todo[start : max(end, start + 1)]
        start += len(mine)
        a, b = int(lo[mine].min()), int(hi[mine].max()) + 1
        scale = float(h[mine].max())
        sums_n, sums_k = powers(a, b, centre, scale)
        c, width = (at[mine] - centre) / scale, h[mine] / scale
        middle = np.searchsorted(x, at[mine], "left") - a
        left, right = np.maximum(np.searchsorted(x, at[mine] - h[mine], "left"), lo[mine]) - a, np.minimum(np.searchsorted(x, at[mine] + h[mine], "right"), hi[mine] + 1) - a
        middle = np.clip(middle, left, right)

        def moment(sums, power, low, high):
            """Sum of ((x - at) / h)^power over scores of a range, by the binomial theorem."""
            total = np.zeros(len(mine))
            for q in range(power + 1):
                total += math.comb(power, q) * (sums[q][high] - sums[q][low]) * (-c) ** (power - q)
            return total / width**power

        cells = {}
        for name, sums, most in (("n", sums_n, 2), ("k", sums_k, 1)):
            for p in range(most + 1):
                cells[name, p] = sum(f * ((-1.0) ** e * moment(sums, e + p, left, middle) + moment(sums, e + p, middle, right)) for e, f in _TRICUBE)
        s0, s1, s2, sy, sxy = cells["n", 0], cells["n", 1], cells["n", 2], cells["k", 0], cells["k", 1]
        if degree == 0:
            out[mine] = sy / np.maximum(s0, 1e-300)
            continue
        det = s0 * s2 - s1 * s1
        fine = det > 1e-10 * s0 * s0
        value = np.where(fine, (s2 * sy - s1 * sxy) / np.where(fine, det, 1.0), sy / np.maximum(s0, 1e-300))
        for j in np.flatnonzero(~fine | ~(s0 > 1e-6)):  # nearly one score, or nearly no weight: term by term
            value[j] = _one_place(x[a:b][left[j] : right[j]], n[a:b][left[j] : right[j]], k[a:b][left[j] : right[j]], float(at[mine[j]]), float(h[mine[j]]))
        out[mine] = value
    return out


def _one_place(x: np.ndarray, n: np.ndarray, k: np.ndarray, x0: float, h: float) -> float:
    d = x - x0
    w = np.clip(1 - (np.abs(d) / h) ** 3, 0, None) ** 3
    w[np.abs(d) >= h * (1 - 1e-12)] = 0.0
    if not w.any():  # all rows of the window lie at its border
        return float(k.sum() / n.sum())
    s0, s1, s2, sy, sxy = (w * n).sum(), (w * n * d).sum(), (w * n * d * d).sum(), (w * k).sum(), (w * k * d).sum()
    det = s0 * s2 - s1 * s1
    return float((s2 * sy - s1 * sxy) / det if det > 1e-12 * s0 * s2 else sy / s0)
