"""The catalogue over resamples of more rows than one task holds.

Rows stay in ranges of scores. The driver deals the rows of each resample, of each outcome by itself, over the ranges, so a range knows
which ranks of the resample are its own; it draws its share from a seed of resample and range, and draws the same again in every pass.
A pass sends small sums only, and metrics that need what is not known before (edges, windows, coefficients) ask for another pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import special
from ..functions.exprs import bin_index, logit
from ..session import ship
from .frame import Frame, S, W, Y, merged
from .local_regression import _POWERS, Cells, borders
from .solvers import irls

#: Rows of a range, about; rows of one score stay together.
RANGE_ROWS = 200_000
#: Resamples that share passes: what the driver holds at once is in proportion.
GROUP = 20
#: Cells of equal mass, and as many of equal width, for the moments of the local regression.
MOMENT_CELLS = 2048
GRID, FRAC = 512, 0.75
_TINY = 1 << 20


class Part:
    """Rows of a range in the order of score and row."""

    def __init__(self, at: int, number: int, s: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.at, self.number, self.s, self.y, self.w = at, number, s, y, w
        self.first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        self.own = np.flatnonzero(y < 0.5), np.flatnonzero(y > 0.5)
        self.d = w * (y - s)

    @cached_property
    def z(self) -> np.ndarray:
        return np.log(self.s) - np.log1p(-self.s)

    @cached_property
    def terms(self) -> np.ndarray:
        s, y, w = self.s, self.y, self.w
        loss = -(y * np.log(s) + (1 - y) * np.log1p(-s))
        return np.stack([w, w * loss, w * (s - y) ** 2, w * y, w * s, self.d, self.d * (1 - 2 * s), w * w * (1 - 2 * s) ** 2 * s * (1 - s)], axis=1)

    def draw(self, seed: int, number: int, sizes: Sequence[int]) -> np.ndarray:
        """How often each row is drawn."""
        rng, c = np.random.default_rng([seed, number, self.number]), np.zeros(len(self.s))
        for rows, size in zip(self.own, sizes):
            if size:
                c[rows] = np.bincount(rng.integers(0, len(rows), size), minlength=len(rows))
        return c


# What a range sends of resample i, drawn c times each; ``g`` is what the driver gives to the pass.


def _sums(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    held = np.flatnonzero(c)
    return np.r_[c @ t.terms, t.s[held[0]], t.s[held[-1]], (np.add.reduceat(c, t.first) > 0).sum()]


def _pick(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    """Scores at the wanted ranks of this range, in order."""
    upto = g["starts"][i, t.at] + np.cumsum(c)
    a, b = np.searchsorted(g["ranks"][i], [g["starts"][i, t.at], upto[-1]])
    return t.s[np.searchsorted(upto, g["ranks"][i][a:b], "right")]


def _binned(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    """Number of the first cell between edges, then rows, w, w s and w y of each cell."""
    edges = g["edges"][i]
    a, b = np.searchsorted(edges, [t.s[0], t.s[-1]], "right")
    cut = np.r_[0, np.searchsorted(t.s, edges[a:b], "left"), len(t.s)]
    return np.r_[a, np.stack([np.diff(np.r_[0.0, np.cumsum(c * x)][cut]) for x in (1.0, t.w, t.w * t.s, t.w * t.y)]).ravel()]


def _walked(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    walk = np.abs(g["reached"][i, t.at] + np.cumsum(np.repeat(t.d, c.astype(np.int64))))
    return np.array([walk.max(), walk.sum()])


def _lattice(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray | None:
    """Number of the first cell of logits, then the residual mass of each cell."""
    low, width, count = g["lattice"][i]
    if not count:
        return None
    held = np.flatnonzero(c)
    cell = np.clip((t.z[held] - low) // width, 0, count - 1).astype(np.int64)
    return np.r_[cell[0], np.bincount(cell - cell[0], (c * t.d)[held])]


def _dense(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray | None:
    """The smoothed residual mass at 257 points; masses beyond 12 sigma add nothing that a double holds."""
    low, high, sigma = g["dense"][i]
    if not sigma:
        return None
    z, m = t.z[t.first], np.add.reduceat(c * t.d, t.first)
    at = np.linspace(low - 5 * sigma, high + 5 * sigma, 257)
    ends = np.searchsorted(z, [at - 12 * sigma, at + 12 * sigma])
    return np.array([np.exp(-0.5 * ((x - z[a:b]) / sigma) ** 2) @ m[a:b] for x, a, b in zip(at, *ends)])


def _slopes(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray | None:
    """Loss, gradient and Hessian of the logistic fits: a constant beside the logit, and a line in it."""
    out = []
    for model, beta in enumerate(g["beta"][i]):
        x = [np.ones_like(t.z)] if model == 0 else [np.ones_like(t.z), t.z]
        eta = t.z + beta[0] if model == 0 else beta[0] + beta[1] * t.z
        w, q = c * t.w, 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        out.append(w @ (np.logaddexp(0, eta) - t.y * eta))
        out += [(w * (t.y - q)) @ a for a in x] + [(w * q * (1 - q) * a) @ b for k, a in enumerate(x) for b in x[: k + 1]]
    return np.array(out)


def _moments(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    """Number of the first cell, then the powers of the distance from the middle, of rows and of events, a row for each cell."""
    edges, middle, half = g["cells"]
    cell = np.clip(np.searchsorted(edges, t.s, "right") - 1, 0, len(edges) - 1)
    x, starts = (t.s - middle[cell]) / half[cell], np.flatnonzero(np.r_[True, np.diff(cell) > 0])
    out = np.zeros((2 * _POWERS, cell[-1] - cell[0] + 1))
    for base, v in ((0, c), (_POWERS, c * t.y)):
        for q in range(_POWERS):
            out[base + q, cell[starts] - cell[0]] = np.add.reduceat(v, starts)
            v = v * x
    return np.r_[cell[0], out.ravel()]


def _apart(t: Part, i: int, c: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct drawn scores: score, distance of the regression, rows and weight."""
    n = np.add.reduceat(c, t.first)
    held = n > 0
    s = t.s[t.first][held]
    return s, np.abs(np.interp(s, *g["line"][i]) - s), n[held], np.add.reduceat(c * t.w, t.first)[held]


def _spread(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    """Weighted sum and maximum of the distances, number of the first step, and sums of rows or weights from step to step."""
    _, a, n, w = _apart(t, i, c, g)
    at = np.searchsorted(g["steps"][i], a, "right")
    return np.r_[w @ a, a.max(), at.min(), np.bincount(at - at.min(), w if g["weighted"] else n)]


def _near(t: Part, i: int, c: np.ndarray, g: dict) -> np.ndarray:
    """For each wanted stretch of distances (stretch, distance, rows or weight)."""
    _, a, n, w = _apart(t, i, c, g)
    out = []
    for k, (low, high) in enumerate(g["stretches"][i]):
        some = (a >= low) & (a < high)
        out.append(np.stack([np.full(some.sum(), float(k)), a[some], (w if g["weighted"] else n)[some]]))
    return np.concatenate(out, axis=1).ravel()


class Resamples:
    """Rows of a frame in ranges of scores, and resamples of them."""

    def __init__(self, f: Frame, rows: int, seed: int, stratify: bool):
        self.spark = f.df.sparkSession
        ship(self.spark)
        self.rows, self.seed, self.stratify, self.weighted = rows, seed, stratify, f.weighted
        ranges = max(2, math.ceil(rows / RANGE_ROWS))
        ends, cells = np.arange(1, ranges) / ranges, np.linspace(0, 1, MOMENT_CELLS + 1)
        at = np.array(f.quantiles([*ends, *cells]))
        edges = sorted(set(at[: len(ends)].tolist()))
        self.cells = borders(at[len(ends) :], MOMENT_CELLS)
        order = ["row_id"] if "row_id" in f.df.columns else []
        placed = f.df.select(*order, "s", "y", "w", bin_index(S(), edges).alias("part"))
        self.df = placed.repartitionByRange(ranges, "part").sortWithinPartitions("part", "s", *order).select("part", "s", "y", "w").persist()
        sizes = sorted((r["part"], r["n"], int(r["k"])) for r in self.df.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("k")).collect())
        self.parts = {p: j for j, (p, _, _) in enumerate(sizes)}
        self.sizes = np.array([[n - k for _, n, k in sizes], [k for _, _, k in sizes]], np.int64)

    def done(self) -> None:
        self.df.unpersist()

    def shares(self, numbers: Sequence[int]) -> np.ndarray:
        """Rows that each resample draws of each outcome in each range."""
        out = np.zeros((len(numbers), *self.sizes.shape), np.int64)
        for i, number in enumerate(numbers):
            rng, totals = np.random.default_rng([self.seed, number]), self.sizes.sum(axis=1)
            if not self.stratify:
                for _ in range(100):
                    events = int(rng.binomial(self.rows, totals[1] / self.rows))
                    if 0 < events < self.rows:
                        break
                else:
                    raise RuntimeError("100 resamples in a row had one outcome only; use stratify=True")
                totals = np.array([self.rows - events, events])
            for v in (0, 1):
                some = np.flatnonzero(self.sizes[v])
                out[i, v, some] = rng.multinomial(totals[v], self.sizes[v, some] / self.sizes[v].sum())
        return out

    def run(self, numbers: Sequence[int], works: dict[str, Callable], given: dict) -> dict[str, list[list[tuple[int, np.ndarray]]]]:
        """For each work and resample, what the ranges send: (place of the range, array) in order."""
        sent, seed, parts = self.spark.sparkContext.broadcast({**given, "numbers": list(numbers)}), self.seed, self.parts

        def run(batches):
            held = [b for b in batches if len(b)]
            for number, t in pd.concat(held).groupby("part") if held else ():
                part, g, out = Part(parts[int(number)], int(number), *(t[c].to_numpy(float) for c in "syw")), sent.value, []
                for i, resample in enumerate(g["numbers"]):
                    sizes = g["shares"][i, :, part.at]
                    if not sizes.sum():
                        continue
                    c = part.draw(seed, resample, sizes)
                    for name, work in works.items():
                        got = work(part, i, c, g)
                        if got is not None:
                            out.append((name, i, part.at, np.asarray(got, float).tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=["work", "i", "place", "data"])

        got = sorted(self.df.mapInPandas(run, "work string, i int, place int, data binary").collect(), key=lambda r: r["place"])
        sent.destroy()
        out: dict[str, list] = {name: [[] for _ in numbers] for name in works}
        for r in got:
            out[r["work"]][r["i"]].append((r["place"], np.frombuffer(r["data"])))
        return out


class _Newton:
    """Newton steps of both logistic fits in all resamples at once; a step that raises the loss is halved."""

    def __init__(self, count: int, start: Sequence[np.ndarray]):
        self.beta = [[np.array(b, float) for b in start] for _ in range(count)]
        self.trial = [[b.copy() for b in own] for own in self.beta]
        self.step = [[np.full(len(b), np.inf) for b in start] for _ in range(count)]
        self.now = [[np.inf for _ in start] for _ in range(count)]
        self.open = {(i, m) for i in range(count) for m in range(len(start))}
        self.rounds = 0

    def take(self, got: list[list[tuple[int, np.ndarray]]]) -> None:
        self.rounds += 1
        for i, m in sorted(self.open):
            sums = sum(a for _, a in got[i])
            loss, gradient, low = (sums[0], sums[1:2], sums[2:3]) if m == 0 else (sums[3], sums[4:6], sums[6:9])
            step, now = self.step[i][m], self.now[i][m]
            if loss > now + 1e-12 * abs(now) and np.abs(step).max() > 1e-12:
                self.step[i][m] = step / 2
                self.trial[i][m] = self.beta[i][m] + step / 2
                continue
            self.beta[i][m], self.now[i][m] = self.trial[i][m], loss
            if np.abs(step).max() < 1e-10 * (1 + np.abs(self.beta[i][m]).max()) or self.rounds >= 100:
                self.open.discard((i, m))
                continue
            k = m + 1
            hessian = np.zeros((k, k))
            hessian[np.tril_indices(k)] = low
            self.step[i][m] = np.linalg.solve(hessian + np.tril(hessian, -1).T + 1e-12 * np.eye(k), gradient)
            self.trial[i][m] = self.beta[i][m] + self.step[i][m]


class _Group:
    """The metrics of a few resamples, pass by pass."""

    def __init__(self, r: Resamples, numbers: Sequence[int], asked: set[str], start: Sequence[np.ndarray]):
        self.r, self.numbers, self.asked = r, list(numbers), asked
        self.count = len(self.numbers)
        self.given: dict = {"shares": r.shares(self.numbers), "weighted": r.weighted, "cells": r.cells}
        ends = np.cumsum(self.given["shares"].sum(axis=1), axis=1)
        self.given["starts"] = np.c_[np.zeros(self.count, np.int64), ends[:, :-1]]
        self.newton = _Newton(self.count, start) if asked & {"intercept", "slope"} else None
        self.out: list[dict[str, float]] = [{} for _ in self.numbers]

    def run(self, works: dict[str, Callable], **given) -> dict:
        """A pass; open Newton steps join it."""
        if self.newton and self.newton.open:
            works, given["beta"] = {**works, "slopes": _slopes}, self.newton.trial
        got = self.r.run(self.numbers, works, {**self.given, **given})
        if "slopes" in works:
            self.newton.take(got["slopes"])
        return got

    def at_ranks(self, ranks: np.ndarray, works: dict[str, Callable] | None = None, **given) -> tuple[np.ndarray, dict]:
        """The scores of these ranks of each resample, and what the other works of the pass send."""
        order = np.argsort(ranks, axis=1, kind="stable")
        got = self.run({**(works or {}), "pick": _pick}, ranks=np.take_along_axis(ranks, order, axis=1), **given)
        out = np.empty(ranks.shape)
        np.put_along_axis(out, order, np.array([np.concatenate([a for _, a in own]) for own in got["pick"]]), axis=1)
        return out, got

    def metrics(self) -> list[dict[str, float]]:
        rows, asked, reach = self.r.rows, self.asked, int(min(max(math.ceil(FRAC * self.r.rows), 2), self.r.rows))
        most = min(rows, 100) if "ece_sweep" in asked else 15
        levels = np.array(sorted({k / b for b in ([*range(2, most + 1), 15]) for k in range(1, b)}) if asked & {"ece", "ece_debiased", "mce", "ece_sweep"} else [])
        grid = np.linspace(0, 1, GRID) if asked & {"ici", "e50", "e90", "emax"} else np.zeros(0)
        probes = np.unique(np.linspace(0, rows - reach - 1, 1024).astype(np.int64)) if len(grid) and rows > reach else np.zeros(0, np.int64)
        at = np.r_[levels, grid] * (rows - 1)
        wanted = np.r_[np.floor(at), np.ceil(at), probes, probes + reach].astype(np.int64)
        x, got = self.at_ranks(np.tile(wanted, (self.count, 1)), {"sums": _sums})
        low, high = x[:, : len(at)], x[:, len(at) : 2 * len(at)]
        x, ahead = low + (high - low) * (at - np.floor(at)), x[:, 2 * len(at) :]
        self._summed(got["sums"])
        edges, anchors = x[:, : len(levels)], x[:, len(levels) :]

        works: dict[str, Callable] = {"walked": _walked} if asked & {"ecce_max", "ecce_mean"} else {}
        given: dict = {"reached": self.reached}
        if len(levels):
            works["binned"], given["edges"] = _binned, [np.unique(e) for e in edges]
        if "smooth_ece" in asked:
            cells = [8192 if n > 8192 and hi > lo else 0 for lo, hi, n in self.spans]
            works["lattice"], given["lattice"] = _lattice, [(lo, (hi - lo) / max(c, 1), c) for (lo, hi, _), c in zip(self.spans, cells)]
        got = self.run(works, **given)
        for i, out in enumerate(self.out):
            if "walked" in works:
                out["ecce_max"] = max(a[0] for _, a in got["walked"][i]) / self.totals[i]
                out["ecce_mean"] = sum(a[1] for _, a in got["walked"][i]) / rows / self.totals[i]
            if "binned" in works:
                self._bins(i, levels, edges[i], got["binned"][i], most)
        if "smooth_ece" in asked:
            self._smooth(got["lattice"], cells)
        if len(grid):
            self._regression(anchors, probes, ahead, reach)
        while self.newton and self.newton.open:
            self.run({})
        for i, out in enumerate(self.out):
            if self.newton:
                out["intercept"], out["slope"] = float(self.newton.beta[i][0][0]), float(self.newton.beta[i][1][1])
        return self.out

    def _summed(self, got: list) -> None:
        self.totals, self.spans, self.reached = [], [], np.zeros_like(self.given["starts"], dtype=float)
        for i, own in enumerate(got):
            w, loss, square, wy, ws, _, top, spread = sum(a[:8] for _, a in own)
            base, out = wy / w, self.out[i]
            out["log_loss"], out["brier"] = loss / w, square / w
            out["brier_skill"] = 1 - out["brier"] / (base * (1 - base)) if 0 < base < 1 else math.nan
            out["spiegelhalter_z"] = top / math.sqrt(spread) if spread > 0 else math.nan
            out["spiegelhalter_p"] = 2 * (1 - special.norm_cdf(abs(out["spiegelhalter_z"])))
            out["ece_sweep"] = abs(ws / w - base)
            self.totals.append(w)
            ends = np.array([own[0][1][8], own[-1][1][9]])
            self.spans.append((*(np.log(ends) - np.log1p(-ends)).tolist(), int(sum(a[10] for _, a in own))))
            for (p, _), start in zip(own, np.cumsum([0.0, *(a[5] for _, a in own)])):
                self.reached[i, p] = start

    def _bins(self, i: int, levels: np.ndarray, own: np.ndarray, got: list, most: int) -> None:
        every, out = np.unique(own), self.out[i]
        cells = np.zeros((4, len(every) + 1))
        for _, a in got:
            part, first = a[1:].reshape(4, -1), int(a[0])
            cells[:, first : first + part.shape[1]] += part

        def bins(count):
            n, *sums = merged(every, np.unique(own[np.searchsorted(levels, np.arange(1, count) / count)]), cells)
            return [x[n > 0] for x in (n, *sums)]

        n, w, ws, wy = bins(15)
        p, r = ws / w, wy / w
        gap = np.abs(p - r)
        out["ece"], out["mce"] = float(w @ gap / w.sum()), float(gap.max())
        less = np.where(n > 1, np.sqrt(np.maximum(gap * gap - r * (1 - r) / np.maximum(n - 1, 1), 0)), gap)
        out["ece_debiased"] = float(w @ less / w.sum())
        for count in range(2, most + 1) if "ece_sweep" in self.asked else ():
            n, w, ws, wy = bins(count)
            if (np.diff(wy / w) >= 0).all():
                out["ece_sweep"] = float(np.abs(ws - wy).sum() / w.sum())

    def _smooth(self, got: list, cells: list[int]) -> None:
        """As ``smooth_ece``: on a lattice, on a finer one, or on 257 points over the distinct logits."""
        from .metrics import _fixed_point, _smoothed_lattice

        left = []

        def solved(i: int, own: list, count: int) -> tuple[float, float]:
            m, width = np.zeros(count), (self.spans[i][1] - self.spans[i][0]) / count
            for _, a in own:
                m[int(a[0]) : int(a[0]) + len(a) - 1] += a[1:] / self.totals[i]
            return _fixed_point(lambda sigma: _smoothed_lattice(m, width, sigma)), width

        finer: dict[int, int] = {}
        for i, count in enumerate(cells):
            if not count:
                left.append(i)
                continue
            value, width = solved(i, got[i], count)
            if max(value, 1e-4) >= 8 * width:
                self.out[i]["smooth_ece"] = value
                continue
            more = math.ceil((self.spans[i][1] - self.spans[i][0]) / (max(value, 1e-4) / 8))
            if more >= self.spans[i][2] or more > _TINY:
                left.append(i)
            else:
                finer[i] = more
        while finer:
            now: dict[int, int] = {}
            while finer and (not now or sum(now.values()) + max(finer.values()) <= 4 * _TINY):
                now.update([finer.popitem()])
            asked = [(lo, (hi - lo) / now[i], now[i]) if i in now else (0.0, 1.0, 0) for i, (lo, hi, _) in enumerate(self.spans)]
            again = self.run({"lattice": _lattice}, lattice=asked)["lattice"]
            for i, count in now.items():
                value, width = solved(i, again[i], count)
                if max(value, 1e-4) >= 8 * width:
                    self.out[i]["smooth_ece"] = value
                else:
                    left.append(i)
        self._pointwise(left)

    def _pointwise(self, left: list[int]) -> None:
        """The fixed points of ``_smoothed_mass`` side by side: a pass for each step of the bisections."""

        def values(sigma: dict[int, float]) -> dict[int, float]:
            got = self.run({"dense": _dense}, dense=[(*self.spans[i][:2], sigma.get(i, 0.0)) for i in range(self.count)])["dense"]
            out = {}
            for i, by in sigma.items():
                at = np.linspace(self.spans[i][0] - 5 * by, self.spans[i][1] + 5 * by, 257)
                out[i] = float(np.trapezoid(np.abs(sum(a for _, a in got[i]) / self.totals[i] / (by * math.sqrt(2 * math.pi))), at))
            return out

        if not left:
            return
        least = values({i: 1e-4 for i in left})
        between = {i: (1e-4, 2.0) for i in left if least[i] > 1e-4}
        for i in set(left) - set(between):
            self.out[i]["smooth_ece"] = least[i]
        while between and next(iter(between.values()))[1] - next(iter(between.values()))[0] >= 1e-4:  # all have the same width
            got = values({i: (a + b) / 2 for i, (a, b) in between.items()})
            between = {i: ((a + b) / 2, b) if got[i] > (a + b) / 2 else (a, (a + b) / 2) for i, (a, b) in between.items()}
        for i, (a, b) in between.items():
            self.out[i]["smooth_ece"] = (a + b) / 2

    def _regression(self, anchors: np.ndarray, probes: np.ndarray, ahead: np.ndarray, reach: int) -> None:
        """Distances of the local regression at the anchors, interpolated between them."""
        last = self.r.rows - reach
        low, high = np.zeros(anchors.shape, np.int64), np.full(anchors.shape, last, np.int64)
        if len(probes):  # the first row i whose window can't move right any more: x[i] + x[i + reach] >= 2 at
            for i in range(self.count):
                k = np.searchsorted(ahead[i, : len(probes)] + ahead[i, len(probes) :], 2 * anchors[i], "left")
                low[i] = np.where(k > 0, probes[np.maximum(k, 1) - 1] + 1, 0)
                high[i] = np.where(k < len(probes), probes[np.minimum(k, len(probes) - 1)], last)
        while (low < high).any():
            step = np.maximum(-(-(high - low) // 16), 1)
            some = np.minimum(low[..., None] + step[..., None] * np.arange(16), np.maximum(high[..., None] - 1, 0))
            flat = some.reshape(self.count, -1)
            x, _ = self.at_ranks(np.c_[flat, np.minimum(flat + reach, self.r.rows - 1)])
            good = (x[:, : flat.shape[1]] + x[:, flat.shape[1] :]).reshape(some.shape) >= 2 * anchors[..., None]
            j = np.where(good.any(axis=2), good.argmax(axis=2), 16)
            pick = lambda k: np.take_along_axis(some, k[..., None], axis=2)[..., 0]
            live = low < high
            low, high = np.where(live & (j > 0), pick(np.maximum(j, 1) - 1) + 1, low), np.where(live & (j < 16), pick(np.minimum(j, 15)), high)
        x, got = self.at_ranks(np.c_[low, low + reach - 1], {"moments": _moments})
        h = np.maximum(anchors - x[:, :GRID], x[:, GRID:] - anchors)
        _, middle, half = self.r.cells
        line, steps, bound = [], [], np.linspace(0, 1, 17)[:-1]
        for i in range(self.count):
            sums = np.zeros((2 * _POWERS, len(middle)))
            for _, a in got["moments"][i]:
                part, first = a[1:].reshape(2 * _POWERS, -1), int(a[0])
                sums[:, first : first + part.shape[1]] += part
            held = sums[0] > 0
            own, places = np.unique(anchors[i], return_index=True)
            fit = Cells(middle[held], half[held], sums[:, held]).fits(own, h[i][places])
            line.append((own, fit))
            gap = fit - own  # straight between anchors: points between them say where distances are dense
            steps.append(np.unique(np.abs(np.r_[(gap[:-1, None] + np.diff(gap)[:, None] * bound).ravel(), gap[-1]])))
        got = self.run({"spread": _spread}, line=line, steps=steps)["spread"]
        stretches, starts, places = [], [], []
        for i, own in enumerate(got):
            self.out[i]["ici"], self.out[i]["emax"] = float(sum(a[0] for _, a in own) / self.totals[i]), float(max(a[1] for _, a in own))
            sums = np.zeros(len(steps[i]) + 1)
            for _, a in own:
                sums[int(a[2]) : int(a[2]) + len(a) - 3] += a[3:]
            full = np.flatnonzero(sums)
            ends, border = np.cumsum(sums[full]), np.r_[-np.inf, steps[i], np.inf]
            at = [q * (ends[-1] if self.r.weighted else self.r.rows - 1) for q in (0.5, 0.9)]
            k = [min(int(np.searchsorted(ends, math.floor(v) if not self.r.weighted else v, "right")), len(full) - 1) for v in at]
            stretches.append([(border[full[max(j - 1, 0)]], border[full[min(j + 1, len(full) - 1)] + 1]) for j in k])
            starts.append([float(ends[j - 2]) if j > 1 else 0.0 for j in k])
            places.append(at)
        got = self.run({"near": _near}, line=line, stretches=stretches)["near"]
        for i, own in enumerate(got):
            rows = np.concatenate([a.reshape(3, -1) for _, a in own], axis=1)
            for k, name in enumerate(("e50", "e90")):
                _, x, size = rows[:, rows[0] == k]
                order = np.argsort(x, kind="stable")
                x, upto, at = x[order], starts[i][k] + np.cumsum(size[order]), places[i][k]
                if self.r.weighted:
                    self.out[i][name] = float(np.interp(at, upto - size[order] / 2, x))
                else:
                    a, b = (x[min(np.searchsorted(upto, v, "right"), len(x) - 1)] for v in (math.floor(at), math.ceil(at)))
                    self.out[i][name] = float(a + (b - a) * (at - math.floor(at)))


def resampled(f: Frame, rows: int, names: Sequence[str], replicates: int, seed: int, stratify: bool) -> np.ndarray:
    """The named metrics of each resample, a row for each."""
    asked, start = set(names), ()
    if asked & {"intercept", "slope"}:
        start = (irls(f.df, [F.lit(1.0)], Y(), W(), offset=logit(S())).beta, irls(f.df, [F.lit(1.0), logit(S())], Y(), W()).beta)
    r = Resamples(f, rows, seed, stratify)
    try:
        got = [out for a in range(0, replicates, GROUP) for out in _Group(r, range(a, min(a + GROUP, replicates)), asked, start).metrics()]
    finally:
        r.done()
    return np.array([[out[c] for c in names] for out in got])
