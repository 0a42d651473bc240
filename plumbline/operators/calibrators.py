"""Calibration maps: ``fit(frame)`` gives a small model; its prediction is a Column (or an Arrow lookup for long tables)."""

from __future__ import annotations

import functools
import heapq
import inspect
import math
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, clipped, expit, logit, pick
from ..session import ship
from .frame import MAX_POINTS, Frame, S, TooManyPoints, W, Y, merged, prefixed
from .solvers import irls, isotonic_blocks, pava, root_1d, together



#: Distinct pairs of fold and score that a spline is fitted to on the driver; more stay on the executors.
SPLINE_PAIRS = 500_000
#: Rows of a range that one task walks in order.
RANGE_ROWS = 200_000
#: Distinct scores whose nearly isotonic path is walked on the driver from its start; of more, ranges walk the part that no good fit is in.
PATH_SCORES = 250_000
#: About as many blocks are left to the driver's walk.
PATH_BLOCKS = 100_000


class Unattainable(ValueError):
    """A calibrated target that the map does not reach."""


def _only_fitted(method):
    @functools.wraps(method)
    def checked(self, *args, **options):
        self._check()
        return method(self, *args, **options)

    return checked


def buffered(lo: float, hi: float, space: str, buffer_logit: float) -> tuple[float, float]:
    """A calibrated interval, checked, and shrunk by a buffer on the log-odds scale; its open ends stay open."""
    if space not in ("probability", "logit"):
        raise ValueError("space is 'probability' or 'logit'")
    if not 0 <= lo <= hi <= 1:
        raise ValueError("0 <= lo <= hi <= 1 is needed")
    if buffer_logit < 0:
        raise ValueError("the buffer can't be negative")
    if buffer_logit:
        lo, hi = (_sigma(_logit(lo) + buffer_logit) if lo > 0 else lo), (_sigma(_logit(hi) - buffer_logit) if hi < 1 else hi)
        if lo > hi:
            raise Unattainable("the buffer leaves nothing of the interval")
    return lo, hi


def broadcast(value):
    """A driver object for all tasks, sent to each executor once; its owner has bounded its size by ``MAX_POINTS``."""
    return SparkContext.getOrCreate().broadcast(value)


def lookup(xs: np.ndarray, ys: np.ndarray, linear: bool = False):
    """Column function: the step (value of the last x not above) or the line through (xs, ys), clamped at both ends.

    Up to 128 steps are an array literal; longer tables, of ``MAX_POINTS`` knots at most, are broadcast."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    if len(xs) > MAX_POINTS + 2:
        raise ValueError(f"a map of more than {MAX_POINTS} knots")
    if not linear and len(xs) <= 128:
        return lambda c: pick(F.greatest(bin_index(c, list(xs)) - 1, F.lit(0)), list(ys))

    table = broadcast((xs, ys))

    @F.pandas_udf("double")
    def look(s: pd.Series) -> pd.Series:
        xs, ys = table.value
        if linear:
            return pd.Series(np.interp(s, xs, ys))
        return pd.Series(ys[np.clip(np.searchsorted(xs, s, "right") - 1, 0, len(xs) - 1)])

    return look


class Calibrator:
    """Subclasses set parameters in ``_fit`` and give ``predict(column)``, ``local(array)`` and ``readings()``."""

    rank = 100.0
    monotone = True
    fitted = False

    def __new__(cls, *args, **options):
        out = super().__new__(cls)
        try:
            bound = inspect.signature(cls.__init__).bind(out, *args, **options)
        except TypeError:  # made anew by pickle, which fills in the state itself
            return out
        bound.apply_defaults()
        out._options = {k: v for k, v in bound.arguments.items() if k not in ("self", "args", "kwargs")}
        return out

    def __init_subclass__(cls, **options):
        super().__init_subclass__(**options)
        for name in ("predict", "predict_interval"):
            if name in cls.__dict__:
                setattr(cls, name, _only_fitted(cls.__dict__[name]))

    def get_params(self) -> dict:
        """The parameters it was made with."""
        return dict(self._options)

    def set_params(self, **options) -> Calibrator:
        """Make it anew, unfitted, with some parameters changed."""
        unknown = set(options) - set(self._options)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}; there are {sorted(self._options)}")
        fresh = type(self)(**{**self._options, **options})
        self.__dict__.clear()
        self.__dict__.update(fresh.__dict__)
        return self

    def clone(self) -> Calibrator:
        """An unfitted one with the same parameters."""
        return type(self)(**self._options)

    def predict_proba_2d(self, score: Column) -> Column:
        """The probabilities of both outcomes, as an array."""
        p = self.predict(score)
        return F.array(1 - p, p)

    def fit(self, frame: Frame) -> Calibrator:
        ship(frame.df.sparkSession)
        self._fit(frame)
        self.fitted = True
        return self

    def _check(self) -> None:
        if not self.fitted:
            raise RuntimeError(f"{type(self).__name__} has not been fitted")

    def predict(self, score: Column) -> Column:
        raise NotImplementedError

    def local(self, s: np.ndarray) -> np.ndarray:
        """The same map on the driver, for inverse maps and probes."""
        raise NotImplementedError

    def transform(self, df: DataFrame, score: str = "s", out: str = "p") -> DataFrame:
        self._check()
        ship(df.sparkSession)
        return df.withColumn(out, self.predict(clipped(F.col(score))))

    def parameters(self) -> dict[str, float]:
        return {}

    def readings(self) -> list[str]:
        return []

    def interpret(self, spark) -> DataFrame:
        rows = [(type(self).__name__, k, float(v), None) for k, v in self.parameters().items()] + [(type(self).__name__, None, None, m) for m in self.readings()]
        return spark.createDataFrame(rows, "method string, parameter string, value double, message string")

    def span(self) -> tuple[float, float]:
        lo, hi = self.local(np.array([1e-12, 1 - 1e-12]))
        return float(lo), float(hi)

    def left(self, t: float) -> float:
        """The smallest raw score whose calibrated value is at least t."""
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.local(np.array([mid]))[0] < t else (lo, mid)
        return hi

    def right(self, t: float) -> float:
        """The largest raw score whose calibrated value is at most t."""
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.local(np.array([mid]))[0] <= t else (lo, mid)
        return lo

    def interval_inverse(self, lo: float, hi: float, space: str = "probability", buffer_logit: float = 0.0) -> tuple[float, float]:
        """Raw scores whose calibrated values lie in [lo, hi], shrunk by a buffer on the log-odds scale."""
        self._check()
        if not self.monotone:
            raise NotImplementedError("the map is not monotone")
        lo, hi = buffered(lo, hi, space, buffer_logit)
        low, high = self.span()
        if hi < low or lo > high:
            raise Unattainable(f"[{lo}, {hi}] does not intersect the map's range [{low}, {high}]")
        a, b = (0.0 if lo <= low else self.left(lo)), (1.0 if hi >= high else self.right(hi))
        if space == "logit":
            return (-math.inf if a <= 0 else _logit(a)), (math.inf if b >= 1 else _logit(b))
        return a, b

    def affine(self) -> tuple[float, float] | None:
        """(a, b) if the map is a * logit + b on the log-odds scale."""
        return None

    def point_inverse(self, p: float, space: str = "probability") -> float:
        ab = self.affine()
        if ab is None or ab[0] == 0:
            raise NotImplementedError("no closed point inverse; use interval_inverse")
        z = (_logit(p) - ab[1]) / ab[0]
        return z if space == "logit" else _sigma(z)


def _logit(p: float) -> float:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return math.log(p) - math.log1p(-p)


def _sigma(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


class _Affine(Calibrator):
    a = 1.0
    b = 0.0

    def predict(self, score):
        return expit(self.a * logit(score) + self.b)

    def local(self, s):
        s = np.clip(s, 1e-12, 1 - 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.a * (np.log(s) - np.log1p(-s)) + self.b, -700, 700)))

    def affine(self):
        return self.a, self.b

    def left(self, t):
        return _sigma((_logit(t) - self.b) / self.a)

    right = left


class Platt(_Affine):
    """expit(a * logit(s) + b), fitted to targets smoothed by the (unweighted) class counts."""

    rank = 2.0

    def _fit(self, f):
        got = f.df.agg(F.sum("y").alias("k"), F.count("*").alias("n")).first()
        high, low = (got["k"] + 1) / (got["k"] + 2), 1 / (got["n"] - got["k"] + 2)
        self.b, self.a = irls(f.df, [F.lit(1.0), logit(S())], F.when(Y() > 0.5, high).otherwise(low), W()).beta
        self.monotone = self.a > 0

    def parameters(self):
        return {"a": self.a, "b": self.b}

    def readings(self):
        return ["scores are overconfident: they are drawn together" if self.a < 1 else "scores are underconfident: they are drawn apart", f"odds change by the factor {math.exp(self.b):.6g} at even odds"]


class Temperature(_Affine):
    """expit(logit(s) / T), the one-parameter map; it can't move the base rate."""

    rank = 1.0

    def _fit(self, f):
        z = logit(S())

        def slope(u: float):
            q = expit(u * z)
            return tuple(f.df.agg(F.sum(W() * z * (q - Y())), F.sum(W() * z * z * q * (1 - q))).first())

        low, high = 1e-6, 1e6
        if slope(low)[0] > 0:
            warnings.warn("no finite temperature fits; the boundary is taken", stacklevel=2)
            self.a = low
        else:
            self.a = root_1d(slope, 1.0, low, high)

    def parameters(self):
        return {"T": 1 / self.a}

    def readings(self):
        return ["scores are overconfident" if self.a < 1 else "scores are underconfident", "a temperature can't correct the base rate"]


class Beta(Calibrator):
    """expit(a ln s - b ln(1 - s) + c); variants abm (all), ab (a = b) and a (a = b, c = 0); a and b are kept from below 0."""

    def __init__(self, variant: str = "abm"):
        if variant not in ("abm", "ab", "a"):
            raise ValueError("variant is 'abm', 'ab' or 'a'")
        self.variant = variant
        self.rank = {"abm": 3.0, "ab": 2.5, "a": 1.5}[variant]

    def _fit(self, f):
        self.constrained = False
        one, up, down = F.lit(1.0), F.log(S()), -F.log1p(-S())
        if self.variant == "a":
            z = logit(S())
            value = lambda u: tuple(f.df.agg(F.sum(W() * z * (expit(u * z) - Y())), F.sum(W() * z * z * expit(u * z) * (1 - expit(u * z)))).first())
            self.constrained = value(0.0)[0] > 0
            self.a = self.b = 0.0 if self.constrained else root_1d(value, 1.0, 0.0, 1e6)
            self.c = 0.0
            return
        if self.variant == "ab":
            self.c, self.a = irls(f.df, [one, logit(S())], Y(), W()).beta
            self.b = self.a
            if self.a < 0:
                self._constant(f)
            return
        self.c, self.a, self.b = irls(f.df, [one, up, down], Y(), W()).beta
        if self.a < 0 or self.b < 0:
            self.constrained = True
            drop_a = self.a < 0
            c, rest = irls(f.df, [one, down if drop_a else up], Y(), W()).beta
            self.c, self.a, self.b = (c, 0.0, rest) if drop_a else (c, rest, 0.0)
            if rest < 0:
                self._constant(f)

    def _constant(self, f):
        self.constrained, self.a, self.b = True, 0.0, 0.0
        self.c = _logit(f.df.agg(F.sum(W() * Y()) / F.sum(W())).first()[0])

    def predict(self, score):
        return expit(self.a * F.log(score) - self.b * F.log1p(-score) + self.c)

    def local(self, s):
        s = np.clip(s, 1e-12, 1 - 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(s) - self.b * np.log1p(-s) + self.c, -700, 700)))

    def affine(self):
        return (self.a, self.c) if self.variant != "abm" else None

    def point_inverse(self, p, space="probability"):
        """Raw score with calibrated value p: the map is increasing in the log-odds, so Newton steps in a bracket find it."""
        if self.a == 0 and self.b == 0:
            raise NotImplementedError("the map is constant")
        k = _logit(p) - self.c
        if self.a == self.b:
            z = k / self.a
        else:
            # a ln s - b ln(1-s) in terms of z = logit s: -a softplus(-z) + b softplus(z)
            soft = lambda v: max(v, 0.0) + math.log1p(math.exp(-abs(v)))
            if (self.a == 0 and k <= 0) or (self.b == 0 and k >= 0):
                raise Unattainable(f"{p} lies outside the map's range")
            f = lambda z: (-self.a * soft(-z) + self.b * soft(z) - k, self.a * _sigma(-z) + self.b * _sigma(z))
            z = root_1d(f, k / max(self.a, self.b), -1e6, 1e6)
        return z if space == "logit" else _sigma(z)

    def parameters(self):
        return {"a": self.a, "b": self.b, "c": self.c}

    def readings(self):
        out = [f"odds change by the factor {math.exp(self.c):.6g}"]
        if abs(self.a - self.b) > 0.1:
            out.append("low and high scores are corrected differently")
        return out + (["a constraint is active"] if self.constrained else [])


class _Steps(Calibrator):
    """A step map over right-closed bins."""

    edges: list[float]
    rates: list[float]

    def predict(self, score):
        if len(self.edges) <= 128:
            return pick(bin_index(score, self.edges), self.rates)
        return lookup(np.r_[-np.inf, self.edges], self.rates)(score)

    def local(self, s):
        return np.asarray(self.rates)[np.searchsorted(self.edges, s, "right")]

    def left(self, t):
        k = int(np.argmax(np.asarray(self.rates) >= t))
        return 0.0 if k == 0 else self.edges[k - 1]

    def right(self, t):
        k = int(np.flatnonzero(np.asarray(self.rates) <= t)[-1])
        return 1.0 if k == len(self.edges) else self.edges[k]


class Histogram(_Steps):
    """Event rate by bin, drawn to one half by half an event and half a non-event; an empty bin has the base rate."""

    rank = 10.0

    def __init__(self, n_bins: int = 10, strategy: str = "mass", shrinkage: str | None = "jeffreys"):
        self.n_bins, self.strategy, self.shrinkage = n_bins, strategy, shrinkage

    def _fit(self, f):
        self.edges = f.edges(self.n_bins, self.strategy)
        rows = {r["b"]: r for r in f.df.groupBy(bin_index(S(), self.edges).alias("b")).agg(F.sum("w").alias("w"), F.sum(W() * Y()).alias("k")).collect()}
        base = sum(r["k"] for r in rows.values()) / sum(r["w"] for r in rows.values())
        more = (0.5, 1.0) if self.shrinkage == "jeffreys" else (0.0, 0.0)
        self.rates = [(rows[b]["k"] + more[0]) / (rows[b]["w"] + more[1]) if b in rows else base for b in range(len(self.edges) + 1)]
        self.monotone = bool(np.all(np.diff(self.rates) >= 0))

    def parameters(self):
        return {"n_bins": len(self.rates)}

    def readings(self):
        return [f"{len(self.rates)} bins" + ("" if self.monotone else "; their rates are not in order")]


class ScalingBinning(_Steps):
    """A Platt map, then the mean fitted value of the equal-mass bin of it."""

    rank = 4.0

    def __init__(self, n_bins: int = 10):
        self.n_bins = n_bins

    def _fit(self, f):
        self.platt = Platt().fit(f)
        inner = Frame(f.df.withColumn("g", self.platt.predict(S())), f.weighted)
        self.edges = inner.edges(self.n_bins, column="g")
        rows = dict(map(tuple, inner.df.groupBy(bin_index(F.col("g"), self.edges)).agg(F.sum(W() * F.col("g")) / F.sum("w")).collect()))
        have = sorted(rows)
        self.rates = [float(v) for v in np.interp(range(len(self.edges) + 1), have, [rows[b] for b in have])]
        self.monotone = self.platt.monotone

    def predict(self, score):
        return super().predict(self.platt.predict(score))

    def local(self, s):
        return super().local(self.platt.local(s))

    def left(self, t):
        raw = super().left(t)
        return raw if raw in (0.0, 1.0) else self.platt.left(raw)

    def right(self, t):
        raw = super().right(t)
        return raw if raw in (0.0, 1.0) else self.platt.left(raw)

    def parameters(self):
        return {**self.platt.parameters(), "n_bins": len(self.rates)}


class BBQ(Calibrator):
    """Average of equal-mass histograms of 2 to sqrt(n) (50 at most) bins by their Beta-Binomial evidence."""

    rank = 40.0

    def __init__(self, min_bins: int | None = None, max_bins: int | None = None):
        self.low, self.high = min_bins, max_bins

    def _fit(self, f):
        n = f.df.count()
        low = self.low or 2
        high = max(self.high or min(50, math.ceil(math.sqrt(n))), low)
        levels = sorted({k / b for b in range(low, high + 1) for k in range(1, b)})
        at = dict(zip(levels, f.quantiles(levels)))
        self.edges = [np.unique([at[k / b] for k in range(1, b)]) for b in range(low, high + 1)]
        every = np.unique(list(at.values()))
        cells = f.cells(every)
        n_, k_ = zip(*[merged(every, e, (cells[0], cells[2])) for e in self.edges])
        g = math.lgamma
        half = 2 * g(0.5) - g(1.0)
        log = np.array([sum(g(k + 0.5) + g(m - k + 0.5) - g(m + 1) - half for m, k in zip(ns, ks)) for ns, ks in zip(n_, k_)])
        weight = np.exp(log - log.max())
        self.weights = weight / weight.sum()
        self.rates = [(ks + 0.5) / (ns + 1) for ns, ks in zip(n_, k_)]
        probe = self.local(np.linspace(0.005, 0.995, 199))
        self.monotone = bool(np.all(np.diff(probe) >= -1e-12))
        # the mixture is a step map over all edges together
        self.all_edges = np.unique(np.concatenate(self.edges))
        self.all_rates = self.local(np.r_[0.0, self.all_edges])

    def local(self, s):
        return sum(w * r[np.searchsorted(e, s, "right")] for w, e, r in zip(self.weights, self.edges, self.rates))

    def predict(self, score):
        return lookup(np.r_[-1.0, self.all_edges], self.all_rates)(score)

    def parameters(self):
        return {"n_models": len(self.weights)}

    def readings(self):
        top = np.argsort(-self.weights, kind="stable")[:3]
        return [f"{len(self.rates[k])} bins carry weight {self.weights[k]:.6g}" for k in top]


class Isotonic(Calibrator):
    """Isotonic regression: steps at each block's first score, or (``linear``) a line through the blocks' middles."""

    rank = 50.0

    def __init__(self, interpolation: str = "none"):
        if interpolation not in ("none", "linear"):
            raise ValueError("interpolation is 'none' or 'linear'")
        self.interpolation = interpolation

    def _fit(self, f):
        b = isotonic_blocks(f.df)
        self.first, self.last, self.mean = b[:, 0], b[:, 1], b[:, 3] / b[:, 2]
        self.centre = b[:, 4] / b[:, 2]
        linear = self.interpolation == "linear"
        self.knots = (self.first + self.last) / 2 if linear else self.first

    def predict(self, score):
        return lookup(self.knots, self.mean, self.interpolation == "linear")(score)

    def local(self, s):
        if self.interpolation == "linear":
            return np.interp(s, self.knots, self.mean)
        return self.mean[np.clip(np.searchsorted(self.knots, s, "right") - 1, 0, len(self.mean) - 1)]

    def left(self, t):
        if self.interpolation == "linear":
            return super().left(t)
        return float(self.first[int(np.argmax(self.mean >= t))])

    def right(self, t):
        if self.interpolation == "linear":
            return super().right(t)
        return float(self.first[int(np.flatnonzero(self.mean <= t)[-1]) + 1])

    def parameters(self):
        return {"n_blocks": len(self.mean)}

    def readings(self):
        return [f"{len(self.mean)} levels from {self.mean[0]:.6g} to {self.mean[-1]:.6g}", "values outside that range are never predicted"]


class CenteredIsotonic(Isotonic):
    """A line through the weighted centres of the isotonic blocks: strictly increasing between them."""

    def __init__(self):
        super().__init__("linear")

    def _fit(self, f):
        super()._fit(f)
        self.knots = self.centre


class VennAbers(Calibrator):
    """Inductive Venn-Abers: isotonic values at a new score labelled 0 and labelled 1, by tangents between two lower hulls.

    Rows are range-sorted by (score, row_id); ties are not pooled. Each range hands on the lower hull of its own points, and then walks
    its points between the hulls of the ranges before and after it: any number of rows will do. Neighbouring scores alike in both values
    are one step; only hulls and steps reach the driver (``MAX_POINTS`` steps at most)."""

    rank = 60.0

    def _fit(self, f):
        order = ["s", *(["row_id"] if "row_id" in f.df.columns else [])]
        parts = max(1, math.ceil(f.df.count() / RANGE_ROWS))
        rows = f.df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("s", "y", "w", F.spark_partition_id().alias("part")).persist()

        def hulls(batches):
            t = pd.concat(list(batches))
            if len(t):
                c, z = _points(t)
                at = _lower(c, z)
                yield pd.DataFrame({"part": t["part"].iloc[0], "c": c[at], "z": z[at], "s": t["s"].iloc[-1]})

        got = rows.mapInPandas(hulls, "part int, c double, z double, s double").toPandas()
        before, c0, z0, last, ends = {}, 0.0, 0.0, -1.0, []
        for part, t in got.sort_values(["part", "c"], kind="stable").groupby("part"):
            before[part] = c0, z0, last
            ends.append((part, c0 + t["c"].to_numpy(), z0 + t["z"].to_numpy()))
            c0, z0, last = ends[-1][1][-1], ends[-1][2][-1], float(t["s"].iloc[0])
        shared = broadcast((before, ends))

        def steps(batches):
            t = pd.concat(list(batches))
            if not len(t):
                return
            part = int(t["part"].iloc[0])
            before, ends = shared.value
            c0, z0, last = before[part]
            side = lambda some: [np.concatenate(x) if x else np.empty(0) for x in zip(*[e[1:] for e in some])] or [np.empty(0)] * 2
            left, right = side([e for e in ends if e[0] < part]), side([e for e in ends if e[0] > part])
            low, high = _lower(*left) if len(left[0]) else [], _lower(*right) if len(right[0]) else []
            c, z = _points(t)
            c, z = c0 + c, z0 + z
            # the hulls before and after meet the own points in their first and last one
            lc, rc = [left[0][low][:-1], left[1][low][:-1]], [right[0][high][1:], right[1][high][1:]]
            s = t["s"].to_numpy()
            first = np.flatnonzero(np.r_[s[0] != last, s[1:] != s[:-1]])
            places = np.r_[first, len(s)] if part == ends[-1][0] else first
            where = (len(lc[0]) + places).tolist()
            p0, p1 = (np.array(_inserted(np.r_[lc[0], c, rc[0]].tolist(), np.r_[lc[1], z, rc[1]].tolist(), label, where)) for label in (0.0, 1.0))
            if lead := int(first[0]) if len(first) else len(s):  # rows of a score that began before: its step counts them
                yield pd.DataFrame({"x": [last], "p0": np.nan, "p1": np.nan, "n": lead})
            if not len(places):
                return
            x, n = np.r_[s, np.inf][places], np.diff(np.r_[places, len(s)])
            new = np.r_[True, (p0[1:] != p0[:-1]) | (p1[1:] != p1[:-1])]
            to = np.flatnonzero(np.r_[new[1:], True])
            yield pd.DataFrame({"x": x[to], "p0": p0[to], "p1": p1[to], "n": np.add.reduceat(n, np.flatnonzero(new))})

        got = rows.mapInPandas(steps, "x double, p0 double, p1 double, n long").limit(MAX_POINTS + 1).toPandas()
        rows.unpersist()
        if len(got) > MAX_POINTS:
            raise ValueError(f"more than {MAX_POINTS} steps of the map")
        found, more = got[got["p0"].notna()].sort_values("x", kind="stable"), got[got["p0"].isna()]
        self.ends, self.p0, self.p1, self.rows = (found[k].to_numpy().copy() for k in ("x", "p0", "p1", "n"))
        np.add.at(self.rows, np.searchsorted(self.ends, more["x"].to_numpy(), "left"), more["n"].to_numpy())

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.ends, s, "left")
        return self.p0[k], self.p1[k]

    def local(self, s):
        a, b = self.interval(np.asarray(s))
        return b / (1 - a + b)

    def predict(self, score):
        model = broadcast(self)

        @F.pandas_udf("double")
        def look(s: pd.Series) -> pd.Series:
            return pd.Series(model.value.local(s.to_numpy()))

        return look(score)

    def predict_interval(self, score: Column) -> Column:
        model = broadcast(self)

        @F.pandas_udf("p0 double, p1 double")
        def look(s: pd.Series) -> pd.DataFrame:
            a, b = model.value.interval(s.to_numpy())
            return pd.DataFrame({"p0": a, "p1": b})

        return look(score)

    def parameters(self):
        width, seen = self.p1 - self.p0, self.rows > 0
        return {"mean_width": float(np.average(width, weights=self.rows)), "max_width": float(width[seen].max())}

    def readings(self):
        return ["the width of the interval is the local uncertainty", "the guarantee covers the interval, not its merged value"]


def _points(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative weights and weighted outcomes of rows in order, from the origin."""
    w = t["w"].to_numpy(float)
    return np.r_[0.0, np.cumsum(w)], np.r_[0.0, np.cumsum(w * t["y"].to_numpy(float))]


def _lower(c: np.ndarray, z: np.ndarray) -> list[int]:
    """Places of the lower hull's corners, for points in the order of c."""
    x, y, out = c.tolist(), z.tolist(), []
    for k in range(len(x)):
        while len(out) > 1 and (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-1]]) >= (y[k] - y[out[-1]]) * (x[out[-1]] - x[out[-2]]):
            out.pop()
        out.append(k)
    return out


def _inserted(c: list[float], z: list[float], label: float, places: Sequence[int] | None = None) -> list[float]:
    """Isotonic value at a unit-weight point put in at each of ``places`` (all, if none): the greatest over starts at most there of the least
    over ends at least there of the slope; found as the tangent of the hull of the points before and of the points after."""
    n = len(c)
    cross = lambda i, j, k: (z[j] - z[i]) * (c[k] - c[j]) - (z[k] - z[j]) * (c[j] - c[i])
    before, after = [-1] * n, [-1] * n  # neighbours on the lower hulls of points 0..k and k..n-1
    for k in range(1, n):
        j = k - 1
        while before[j] >= 0 and cross(before[j], j, k) >= 0:
            j = before[j]
        before[k] = j
    for k in range(n - 2, -1, -1):
        j = k + 1
        while after[j] >= 0 and cross(k, j, after[j]) >= 0:
            j = after[j]
        after[k] = j
    out = []
    for k in range(n) if places is None else places:
        i, j = k, k
        slope = lambda i, j: (z[j] + label - z[i]) / (c[j] + 1 - c[i])
        moved = True
        while moved:
            moved = False
            while after[j] >= 0 and slope(i, after[j]) <= slope(i, j):
                j, moved = after[j], True
            while before[i] >= 0 and slope(before[i], j) >= slope(i, j):
                i, moved = before[i], True
        out.append(slope(i, j))
    return out


def folds(df: DataFrame, cv: int = 5, seed: int = 42) -> DataFrame:
    """A fold column, balanced by class: rows of a class in a fixed shuffled order of row_id, dealt in turn.

    Places in that order come from prefix sums over stretches of it, as one class may hold nearly all rows."""
    turn = (F.col("row_id") * 7919 + seed) % 100003
    dealt = prefixed(df.withColumn("_turn", turn), F.floor(F.col("_turn") / 25), ["_turn", "row_id"], "_place", by=("y",))
    return dealt.withColumn("fold", ((F.col("_place") - 1) % cv).cast("int")).select(*[c for c in df.columns if c != "fold"], "fold")


class CrossVennAbers(Calibrator):
    """Venn-Abers on the complement of each fold, merged by geometric means."""

    rank = 60.0

    def __init__(self, cv: int = 5, seed: int = 42):
        if cv < 2:
            raise ValueError("at least two folds are needed")
        self.cv, self.seed = cv, seed

    def _fit(self, f):
        dealt = folds(f.df, self.cv, self.seed).persist()
        self.parts = together([lambda k=k: VennAbers().fit(Frame(dealt.where(F.col("fold") != k), f.weighted)) for k in range(self.cv)])
        dealt.unpersist()

    def interval(self, s):
        both = [p.interval(np.asarray(s)) for p in self.parts]
        return np.min([b[0] for b in both], axis=0), np.max([b[1] for b in both], axis=0)

    def local(self, s):
        both = [p.interval(np.asarray(s)) for p in self.parts]
        mean = lambda v: np.exp(np.mean(np.log(np.maximum(v, 1e-300)), axis=0))
        one, zero = mean([b[1] for b in both]), mean([1 - b[0] for b in both])
        return one / (zero + one)

    predict = VennAbers.predict
    predict_interval = VennAbers.predict_interval

    def parameters(self):
        a, b = self.interval(np.linspace(0.01, 0.99, 99))
        return {"cv": self.cv, "mean_envelope_width": float((b - a).mean())}


def _falls(hit: np.ndarray, u: np.ndarray, left: float = math.inf, right: float = math.inf) -> np.ndarray:
    """The penalty from which each border falls, as it is known at penalty 0; the borders at the ends as given."""
    return np.r_[left, np.where(np.diff(hit / u) < -1e-15, 0.0, math.inf), right]


def _near_isotonic(hit: np.ndarray, u: np.ndarray, since: np.ndarray | None = None, lam: float = 0.0, until: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The path of nearly isotonic regressions: the number of the merge that takes each border, the penalty from which a border falls
    (infinite: never), and the penalty after each merge. It goes from penalty ``lam``, where borders (both ends too) have fallen
    ``since`` then, to ``until``.

    A block is (outcomes + penalty since the border before it fell - penalty since the one after fell) / weight. Neighbours that are
    equal and drift into a fall count as falling from the next merge on. A merge or a new fall changes the closing times of the
    borders beside it only, and a heap has the next one."""
    n = len(hit)
    h, v = hit.tolist(), u.tolist()
    since = (_falls(hit, u) if since is None else since).tolist()  # of the border before block k
    after, before, times = list(range(1, n + 1)), list(range(-1, n - 1)), [math.inf] * (n + 1)
    gone, lambdas, heap, drifting = [n] * (n + 1), [lam], [], []
    left = sum(x < math.inf for x in since)

    def gap(k):
        i, end = before[k], after[k]
        a, b, c = (lam - x if x <= lam else 0.0 for x in (since[i], since[k], since[end]))
        return (h[k] + b - c) / v[k] - (h[i] + a - b) / v[i]

    def close(k):
        """When block k meets the one before it."""
        i, end = before[k], after[k]
        a, b, c = since[i] <= lam, since[k] <= lam, since[end] <= lam
        speed = (b - c) / v[k] - (a - b) / v[i]
        times[k] = math.inf
        if speed > 0 if b else speed < 0:
            apart = gap(k)
            if b or apart > 0:
                times[k] = max(lam - apart / speed, lam)
                heapq.heappush(heap, (times[k], k))
            else:
                drifting.append(k)

    for k in range(1, n):
        close(k)
    while left and heap and heap[0][0] <= until:
        when, k = heapq.heappop(heap)
        if times[k] != when or gone[k] < n:
            continue
        moved, lam, i, end = when > lam, when, before[k], after[k]
        fallen, waiting = [], []
        if moved:
            for j in set(drifting):
                if gone[j] == n and since[j] == math.inf and j != k:
                    (fallen if gap(j) < -1e-15 else waiting).append(j)
            drifting.clear()
        left -= since[k] < math.inf
        h[i], v[i], after[i] = h[i] + h[k], v[i] + v[k], end
        if end < n:
            before[end] = i
        lambdas.append(lam)
        gone[k] = len(lambdas) - 1
        left += len(fallen)
        for j in fallen:
            since[j] = lam
        beside = {i, end, *waiting}
        for j in fallen:
            beside |= {before[j], j, after[j]}
        for j in beside:
            if 0 < j < n:
                close(j)
    return np.array(gone[1:n], np.int64), np.array(since[1:n]), np.array(lambdas)


def _levels(hit: np.ndarray, u: np.ndarray, gone: np.ndarray, since: np.ndarray, merges: int, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels, first places, outcomes and weights of the blocks after so many merges of a path, at penalty ``lam``."""
    first = np.flatnonzero(np.r_[True, gone > merges])
    h, v = np.add.reduceat(hit, first), np.add.reduceat(u, first)
    fell = np.maximum(lam - since[np.r_[first, len(hit)]], 0)
    return (h + fell[:-1] - fell[1:]) / v, first, h, v


def _likelihood(m: np.ndarray, h: np.ndarray, v: np.ndarray) -> float:
    q = np.clip(m, 1e-12, 1 - 1e-12)
    return float(h @ np.log(q) + (v - h) @ np.log1p(-q))


def _lasting(hit: np.ndarray, u: np.ndarray, lam: float, rows: int, last: bool) -> tuple[int, float] | None:
    """The first border (or the last one) that stands at penalty ``lam`` whatever lies beside these rows, and when it fell: at 0 or never.

    Sums of the fit up to a border lie between those of two walks of the rows alone, with no fall at either end and with a fall at
    both. Where both have the same border, so has the whole; no border comes back, and what lies on both sides of it is apart until then."""
    n, infinite = len(hit), math.inf
    while True:
        rows = min(rows, n)
        at = slice(n - rows, n) if last else slice(0, rows)
        (g0, s0, _), (g1, s1, _) = (_near_isotonic(hit[at], u[at], _falls(hit[at], u[at], end, end), until=lam) for end in (infinite, 0.0))
        both = np.flatnonzero((g0 == rows) & (g1 == rows) & (s0 == s1) & ((s0 == 0) | (s0 == infinite)))
        if len(both):
            k = int(both[-1 if last else 0])
            return at.start + k + 1, float(s0[k])
        if rows == n:
            return None
        rows *= 4


def _walked(s: np.ndarray, hit: np.ndarray, u: np.ndarray, left: float, right: float, grid: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The path between two borders that stand at the last penalty of ``grid``. First scores, outcomes, weights and falls of the blocks
    there (equal ones that never fell apart are one); likelihood, borders and borders between equal blocks at each penalty."""
    gone, since, lambdas = _near_isotonic(hit, u, _falls(hit, u, left, right), until=grid[-1])
    since, sums = np.r_[left, since, right], np.empty((len(grid), 3))
    for i, lam in enumerate(grid):
        m, first, h, v = _levels(hit, u, gone, since, int(np.searchsorted(lambdas, lam, "right")) - 1, lam)
        sums[i] = _likelihood(m, h, v), len(m) - 1, (np.abs(np.diff(m)) <= 1e-12).sum()
    own = np.flatnonzero(np.r_[True, (since[first[1:]] < math.inf) | (np.abs(np.diff(m)) > 1e-15)])
    return [s[first[own]], np.add.reduceat(h, own), np.add.reduceat(v, own), since[first[own]]], sums


class ENIR(Calibrator):
    """Average over the path of nearly isotonic regressions by BIC; the path is walked on the driver over distinct scores.

    The walk is a heap of merges, and a fit anywhere on the path follows from the borders left there, so only fits that can be among
    the best are made. Of more than ``PATH_SCORES`` distinct scores, ranges walk the start of the path, each between two borders that
    outlast it; the driver walks the rows between those and then goes on with the blocks that are left. Likelihoods and borders along the start
    bound its fits; where one of them could be among the best, the driver begins sooner."""

    rank = 80.0
    monotone = False

    def __init__(self, max_solutions: int = 256):
        self.most = max_solutions

    def _fit(self, f):
        if isinstance(f, Frame):
            rows = f.df.groupBy("s").agg(F.sum("w").alias("w"), F.sum(W() * Y()).alias("wy"), F.sum(W() * W()).alias("ww")).persist()
            try:
                if rows.count() > PATH_SCORES and self._fit_far(rows):
                    return
            finally:
                rows.unpersist()
        p = f.pooled()
        self._choose(p["s"], p["wy"], p["w"], _falls(p["wy"], p["w"]))

    def _fit_far(self, rows: DataFrame) -> bool:
        """Whether it was fitted by ranges; if not, it takes the path from penalty 0 over all scores."""
        n, w, wy, ww, low, high = rows.agg(F.count("*"), F.sum("w"), F.sum("wy"), F.sum("ww"), F.min("s"), F.max("s")).first()
        if w <= 1:  # BIC prefers more levels then
            return False
        # blocks at a penalty are about as long as a random walk of the outcomes takes to get that far
        reach = math.sqrt(max(ww * wy / w * (1 - wy / w), 0) / n) * math.sqrt(2.5 * n / PATH_BLOCKS)
        grid, found = np.r_[0.0, np.geomspace(reach / 300, reach, 48)] if reach > 0 else np.zeros(1), False
        ranged = rows.select("s", "wy", "w").repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), "s").sortWithinPartitions("s").persist()
        try:
            while True:
                got = self._start(ranged, low, high, grid, math.ceil(50 * n / PATH_BLOCKS))
                if got is None and (found or not 0 < grid[-1] < 64 * reach):
                    raise TooManyPoints(f"more than {MAX_POINTS} blocks in the fits of least BIC; round the scores first")
                if got is None:
                    grid = np.r_[grid, grid[-1] * np.geomspace(2**0.125, 4, 16)]
                    continue
                (s, h, v, since), sums = got
                again = self._choose(s, h, v, np.r_[since, math.inf], grid, sums)
                if again is None:
                    return True
                if again == 0 and n <= MAX_POINTS:
                    return False
                grid, found = grid[: again + 1], True
        finally:
            ranged.unpersist()

    def _start(self, ranged: DataFrame, low: float, high: float, grid: np.ndarray, rows: int):
        """Blocks of all scores at the last penalty of ``grid``, and sums along it; none, if the blocks are too many for the driver."""
        lam = float(grid[-1])

        def run(batches):
            t = pd.concat([*batches, pd.DataFrame({"s": [], "wy": [], "w": []})])
            if not len(t):
                return
            s, h, v = (t[c].to_numpy(float) for c in ("s", "wy", "w"))
            a = (0, math.inf) if s[0] == low else _lasting(h, v, lam, rows, False)
            b = (len(s), math.inf) if s[-1] == high else a and _lasting(h, v, lam, rows, True)
            known = np.full(len(s), math.nan)
            if a and b and a[0] < b[0]:
                (x, bh, bv, since), sums = _walked(s[a[0] : b[0]], h[a[0] : b[0]], v[a[0] : b[0]], a[1], b[1], grid)
                yield pd.DataFrame({"kind": 0, "s": x, "h": bh, "v": bv, "since": since})
                yield pd.DataFrame({"kind": 2, "s": np.arange(len(grid), dtype=float), "h": sums[:, 0], "v": sums[:, 1], "since": sums[:, 2]})
                if b[0] < len(s):
                    known[b[0]] = b[1]
                left = np.r_[0 : a[0], b[0] : len(s)]
            else:
                left = np.arange(len(s))
            yield pd.DataFrame({"kind": 1, "s": s[left], "h": h[left], "v": v[left], "since": known[left]})

        got = ranged.mapInPandas(run, "kind int, s double, h double, v double, since double").limit(MAX_POINTS + 1).toPandas()
        if len(got) > MAX_POINTS:
            return None
        sums = np.zeros((len(grid), 3))
        along = got[got["kind"] == 2]
        np.add.at(sums, along["s"].to_numpy().astype(int), along[["h", "v", "since"]].to_numpy())
        got = got[got["kind"] < 2].sort_values("s", kind="stable")
        raw = got["kind"].to_numpy() == 1
        cells = [got[c].to_numpy() for c in ("s", "h", "v", "since")]
        out, starts = [], np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
        for i, j in zip(starts, np.r_[starts[1:], len(raw)]):
            part = [c[i:j] for c in cells]
            if raw[i]:  # rows around the border of two ranges, between borders that stand
                part, more = _walked(*part[:3], cells[3][i] if i else math.inf, cells[3][j] if j < len(raw) else math.inf, grid)
                sums += more
            out.append(part)
        return [np.concatenate(c) for c in zip(*out)], sums

    def _choose(self, s: np.ndarray, wy: np.ndarray, w: np.ndarray, since: np.ndarray, grid: np.ndarray = np.zeros(1), sums: np.ndarray | None = None) -> int | None:
        """The average of the path on from the last penalty of ``grid``; or the place in ``grid`` after which fits can be among the best."""
        penalty = math.log(w.sum())
        gone, inner, lambdas = _near_isotonic(wy, w, since, float(grid[-1]))
        since = np.r_[since[0], inner, since[-1]]
        at = lambda j: _levels(wy, w, gone, since, j, lambdas[j])

        def scored(j):
            m, _, h, v = at(j)
            return _likelihood(m, h, v), 1 + int((np.abs(np.diff(m)) > 1e-12).sum())

        # merges at one penalty are one fit
        steps = np.flatnonzero(np.r_[np.diff(lambdas) > 1e-12 * (1 + lambdas[:-1]), True]).tolist()
        place = {j: i for i, j in enumerate(steps)}
        last = steps[-1]
        seen = {j: scored(j) for j in (steps[0], last)}
        # fits with more levels than this have a weight below 1e-15 of the isotonic fit's: they need not be scored
        best = seen[steps[0]][0] if sums is None else sums[0, 0]
        most = seen[last][1] + 2 * (best - seen[last][0] + math.log(1e15)) / penalty if penalty > 0 else math.inf
        bic = lambda j: -2 * seen[j][0] + seen[j][1] * penalty
        fits = lambda j: seen[j][1] <= most and (j > 0 or grid[-1] == 0)  # noqa: E731 (before a merge, there is one at penalty 0 only)
        # along the path the likelihood falls, and borders between unequal blocks last until a merge takes them, so both ends of a stretch
        # bound the fits between; the best bound is halved first
        worst = [-bic(j) for j in seen if fits(j)]
        heapq.heapify(worst)

        def stretch(a, b):
            equal = len(s) - a - seen[a][1]
            least = max(len(s) - b - equal, 1)
            return (-2 * seen[a][0] + (least if penalty > 0 else len(s) - a) * penalty, a, b) if place[b] - place[a] > 1 and least <= most else None

        todo = [x for x in [stretch(steps[0], last)] if x]
        while todo:
            bound, a, b = heapq.heappop(todo)
            if len(worst) >= self.most and bound > -worst[0]:
                break
            j = steps[(place[a] + place[b]) // 2]
            seen[j] = scored(j)
            if seen[j][1] <= most:
                heapq.heappush(worst, -bic(j))
                if len(worst) > self.most:
                    heapq.heappop(worst)
            for x in (stretch(a, j), stretch(j, b)):
                if x:
                    heapq.heappush(todo, x)
        if sums is not None:  # the same bounds for the start of the path
            least = np.maximum(sums[1:, 1] - sums[:-1, 2] + 1, 1)
            bound = -2 * sums[:-1, 0] + (least if penalty > 0 else sums[:-1, 1] + 1) * penalty
            near = np.flatnonzero((least <= most) & ((len(worst) < self.most) | (bound <= -worst[0] if worst else True)))
            if len(near):
                return int(near[0])
        path = sorted((bic(j), j) for j in seen if fits(j))[: self.most]
        share = np.exp(-(np.array([x[0] for x in path]) - path[0][0]) / 2)
        self.weights = share / share.sum()
        mixed = np.zeros(len(s))
        for weight, (_, j) in zip(self.weights, path):
            m, first, _, _ = at(j)
            mixed += weight * np.repeat(m, np.diff(np.r_[first, len(s)]))
        self.scores, self.values = s, np.clip(mixed, 1e-12, 1 - 1e-12)
        self.lambdas = [float(lambdas[j]) for _, j in path]
        return None

    def predict(self, score):
        return lookup(self.scores, self.values)(score)

    def local(self, s):
        return self.values[np.clip(np.searchsorted(self.scores, s, "right") - 1, 0, len(self.values) - 1)]

    def parameters(self):
        return {"n_path_solutions": len(self.lambdas)}


class Spline(Calibrator):
    """Penalised natural cubic spline in the log-odds; the penalty is chosen by held-out log loss.

    Over more than ``SPLINE_PAIRS`` distinct pairs of fold and score, a Newton step of all folds and penalties is one pass of sums."""

    rank = 12.0

    def __init__(self, n_knots: int | None = None, lambdas: Sequence[float] | None = None, cv: int = 5, seed: int = 42):
        self.n_knots, self.lambdas, self.cv, self.seed = n_knots, lambdas, cv, seed

    def basis(self, z: np.ndarray) -> np.ndarray:
        k = self.knots
        cube = lambda t: np.clip(z - t, 0, None) ** 3
        d = [(cube(t) - cube(k[-1])) / (k[-1] - t) for t in k[:-1]]
        return np.stack([np.ones_like(z), z, *[x - d[-1] for x in d[:-1]]], axis=1)

    def _fit(self, f):
        n = f.df.count()
        k = self.n_knots or int(np.clip(math.ceil(n ** (1 / 3)), 4, 12))
        z = Frame(f.df.withColumn("z", logit(S())))
        inner = [j / (k - 1) for j in range(k)]
        self.knots = np.unique(z.quantiles(inner, "z"))
        if len(self.knots) < 3:
            raise ValueError("at least three distinct knots are needed")
        grid = np.asarray(self.lambdas if self.lambdas is not None else np.logspace(-4, 4, 17))
        # ties pooled by fold: the fits of all penalties and folds need these sums only
        dealt = folds(f.df, self.cv, self.seed) if "row_id" in f.df.columns else f.df.withColumn("fold", F.lit(0))
        dealt = dealt.groupBy("fold", "s").agg(F.sum("w").alias("w"), F.sum(W() * Y()).alias("wy"))
        dealt = dealt.persist()
        if dealt.count() > SPLINE_PAIRS:
            self._choose_far(dealt, grid)
            dealt.unpersist()
            return
        rows = dealt.orderBy("s", "fold").toPandas()
        dealt.unpersist()
        s = rows["s"].to_numpy(float)
        x, w, wy, fold = self.basis(np.log(s) - np.log1p(-s)), rows["w"].to_numpy(float), rows["wy"].to_numpy(float), rows["fold"].to_numpy()
        diff = np.diff(np.eye(x.shape[1]), 2, axis=0)
        penalty = diff.T @ diff

        def solve(use, lam):
            beta = np.zeros(x.shape[1])
            for _ in range(100):
                q = 1 / (1 + np.exp(-np.clip(x[use] @ beta, -30, 30)))
                h = (x[use] * (w[use] * q * (1 - q))[:, None]).T @ x[use]
                step = np.linalg.solve(h + lam * penalty + 1e-10 * np.eye(len(beta)), x[use].T @ (wy[use] - w[use] * q) - lam * penalty @ beta)
                beta += step
                if np.abs(step).max() < 1e-10 * (1 + np.abs(beta).max()):
                    break
            return beta, h

        def held(lam):
            out = 0.0
            for k in range(self.cv):
                rest = fold == k
                q = np.clip(1 / (1 + np.exp(-np.clip(x[rest] @ solve(~rest, lam)[0], -30, 30))), 1e-12, 1 - 1e-12)
                out -= float(wy[rest] @ np.log(q) + (w[rest] - wy[rest]) @ np.log1p(-q))
            return out

        self.lam = float(grid[int(np.argmin([held(v) for v in grid]))])
        self._settle(*solve(np.ones(len(s), bool), self.lam), penalty)

    def _settle(self, beta, h, penalty):
        self.beta = beta
        self.edof = float(np.trace(np.linalg.solve(h + self.lam * penalty + 1e-10 * np.eye(len(h)), h)))
        self.monotone = bool(np.all(np.diff(self.local(np.linspace(0.002, 0.998, 399))) >= -1e-10))

    def _choose_far(self, dealt: DataFrame, grid: np.ndarray) -> None:
        """The same choice and fit from sums over (fold, s, w, wy): a task adds up its rows for every penalty and fold at once."""
        shape = Spline()
        shape.knots = self.knots
        d = len(self.knots)
        upper = np.triu_indices(d)
        diff = np.diff(np.eye(d), 2, axis=0)
        penalty = diff.T @ diff

        def sums(betas: np.ndarray, left_out: np.ndarray, held: bool) -> np.ndarray:
            """Hessian and gradient for each problem over the rows outside its fold, or the log loss on those inside."""

            def run(batches):
                total = np.zeros((len(betas), 1 if held else len(upper[0]) + d))
                for t in batches:
                    for a in range(0, len(t), 8192):
                        s, w, wy = (t[c].to_numpy()[a : a + 8192] for c in ("s", "w", "wy"))
                        fold = t["fold"].to_numpy()[a : a + 8192, None]
                        x = shape.basis(np.log(s) - np.log1p(-s))
                        q = 1 / (1 + np.exp(-np.clip(x @ betas.T, -30, 30)))
                        if held:
                            q = np.clip(q, 1e-12, 1 - 1e-12)
                            total[:, 0] -= (np.where(fold == left_out, np.log(q), 0).T @ wy) + (np.where(fold == left_out, np.log1p(-q), 0).T @ (w - wy))
                            continue
                        use = fold != left_out
                        total[:, : len(upper[0])] += (use * q * (1 - q) * w[:, None]).T @ (x[:, upper[0]] * x[:, upper[1]])
                        total[:, len(upper[0]) :] += (use * (wy[:, None] - w[:, None] * q)).T @ x
                yield pd.DataFrame({"problem": np.arange(len(betas)), "v": list(total)})

            got = dealt.mapInPandas(run, "problem int, v array<double>").toPandas()
            return np.array([np.sum(np.stack(v.to_list()), axis=0) for _, v in got.groupby("problem")["v"]])

        def solve(lams: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            betas, hessians, open_ = np.zeros((len(lams), d)), np.zeros((len(lams), d, d)), np.arange(len(lams))
            for _ in range(100):
                for k, v in zip(open_, sums(betas[open_], left_out[open_], False)):
                    h = np.zeros((d, d))
                    h[upper] = v[: len(upper[0])]
                    hessians[k] = h + np.triu(h, 1).T
                    step = np.linalg.solve(hessians[k] + lams[k] * penalty + 1e-10 * np.eye(d), v[len(upper[0]) :] - lams[k] * penalty @ betas[k])
                    betas[k] += step
                    if np.abs(step).max() < 1e-10 * (1 + np.abs(betas[k]).max()):
                        open_ = open_[open_ != k]
                if not len(open_):
                    break
            return betas, hessians

        lams, left_out = np.repeat(grid, self.cv), np.tile(np.arange(self.cv), len(grid))
        loss = sums(solve(lams, left_out)[0], left_out, True)[:, 0].reshape(len(grid), self.cv).sum(axis=1)
        self.lam = float(grid[int(np.argmin(loss))])
        betas, hessians = solve(np.array([self.lam]), np.array([-1]))
        self._settle(betas[0], hessians[0], penalty)

    def local(self, s):
        s = np.clip(s, 1e-12, 1 - 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.basis(np.log(s) - np.log1p(-s)) @ self.beta, -700, 700)))

    def predict(self, score):
        z, k = logit(score), [float(v) for v in self.knots]
        cube = lambda t: F.pow(F.greatest(z - t, F.lit(0.0)), F.lit(3.0))
        d = [(cube(t) - cube(k[-1])) / (k[-1] - t) for t in k[:-1]]
        terms = [F.lit(1.0), z, *[x - d[-1] for x in d[:-1]]]
        return expit(sum((float(b) * t for b, t in zip(self.beta, terms)), F.lit(0.0)))

    def parameters(self):
        return {"edof": self.edof, "lambda": self.lam, "n_knots": len(self.knots)}


__all__ = ["BBQ", "Beta", "Calibrator", "CenteredIsotonic", "CrossVennAbers", "ENIR", "Histogram", "Isotonic", "Platt", "ScalingBinning", "Spline", "Temperature", "Unattainable", "VennAbers", "folds", "pava"]
