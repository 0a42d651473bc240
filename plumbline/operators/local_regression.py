"""Local regression over more distinct scores than one machine holds: exact windows, sums from moments of short cells.

Cells between ``CELLS`` equal masses and as many equal widths hold sums of powers of the distance from their middle, so whole cells
count exactly; a cell on the border of a window, where weights vanish like a cube, or around its place, where both sides' weights
agree to the second derivative, counts by its middle."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .frame import Frame
from .solvers import local_fits

CELLS = 16_384
#: Distinct scores of a range that one task holds.
RANGE_SCORES = 200_000
_POWERS = 12


def _by_part(df: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches):
        t = pd.concat(list(batches))
        if len(t):
            yield make(t)

    return df.mapInPandas(run, schema)


def borders(at: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges, middles and half widths of cells between these quantiles and ``count`` equal widths."""
    alone = np.nextafter(at[1:][at[1:] == at[:-1]], 2)  # a score of more rows than a cell is one by itself
    edges = np.unique(np.r_[at, alone, np.linspace(at[0], at[-1], count + 1)])
    ends = np.r_[edges[1:], edges[-1]]
    return edges, (edges + ends) / 2, np.maximum((ends - edges) / 2, 1e-300)


@dataclass
class Cells:
    """Middles and half widths of the cells that hold scores; ``sums`` has the rows' powers, then the events'."""

    middle: np.ndarray
    half: np.ndarray
    sums: np.ndarray

    def powers(self, a: int, b: int, centre: float, scale: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Prefix sums over cells a to b of the powers of (s - centre) / scale, of rows and of events."""
        off, half = (self.middle[a:b] - centre) / scale, self.half[a:b] / scale
        offs, halves = (np.cumprod(np.vstack([np.ones_like(x), *[x] * (_POWERS - 1)]), axis=0) for x in (off, half))
        out = []
        for own in (self.sums[:_POWERS, a:b], self.sums[_POWERS:, a:b]):
            own = own * halves
            out.append([np.r_[0.0, np.cumsum(sum(math.comb(q, p) * offs[q - p] * own[p] for p in range(q + 1)))] for q in range(_POWERS)])
        return out[0], out[1]

    def fits(self, at: np.ndarray, h: np.ndarray, degree: int = 1) -> np.ndarray:
        slack = h * (1 + 1e-12) + 1e-15
        lo, hi = np.searchsorted(self.middle, at - slack, "left"), np.searchsorted(self.middle, at + slack, "right") - 1
        return local_fits(self.middle, self.sums[0], self.sums[_POWERS], self.powers, np.minimum(lo, hi), hi, at, h, degree)


class Line:
    """Distinct scores in order, range by range: s, rows n, events k, weight w."""

    def __init__(self, f: Frame):
        ship(f.df.sparkSession)
        pooled = f.df.groupBy("s").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k"), F.sum("w").alias("w"))
        ranges = max(1, math.ceil(f.df.agg(F.approx_count_distinct("s")).first()[0] / RANGE_SCORES))
        self.df = pooled.repartitionByRange(ranges, "s").sortWithinPartitions("s").select("*", F.spark_partition_id().alias("part")).persist()
        self.ranges = self.df.groupBy("part").agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("low").toPandas()
        ends = np.cumsum(self.ranges["n"].to_numpy())
        self.rows = int(ends[-1])
        self.starts = dict(zip(self.ranges["part"].tolist(), np.r_[0, ends[:-1]].astype(np.int64).tolist()))

    def done(self) -> None:
        self.df.unpersist()

    def at_ranks(self, ranks: np.ndarray) -> np.ndarray:
        """The score of each row of these ranks, from 0."""
        wanted, starts = np.unique(ranks), self.starts

        def pick(t):
            upto = starts[int(t["part"].iloc[0])] + np.cumsum(t["n"].to_numpy())
            mine = wanted[np.searchsorted(wanted, upto[0] - t["n"].iloc[0]) : np.searchsorted(wanted, upto[-1])]
            return pd.DataFrame({"rank": mine, "x": t["s"].to_numpy()[np.searchsorted(upto, mine, "right")]})

        got = _by_part(self.df, pick, "rank long, x double").toPandas().sort_values("rank")
        return got["x"].to_numpy()[np.searchsorted(got["rank"].to_numpy(), ranks)]

    def quantiles(self, levels: Sequence[float]) -> np.ndarray:
        at = np.asarray(levels, float) * (self.rows - 1)
        low, high = np.split(self.at_ranks(np.r_[np.floor(at), np.ceil(at)].astype(np.int64)), 2)
        return low + (high - low) * (at - np.floor(at))

    def first(self, at: np.ndarray, r: int) -> np.ndarray:
        """The first row of the window of ``r`` rows about each place: the least i whose score and that of i + r are as near, or the last."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.rows - r, np.int64)
        while (low < high).any():
            step = np.maximum(-(-(high - low) // 64), 1)
            probes = low[:, None] + step[:, None] * np.arange(64)
            inside = probes < high[:, None]
            some = probes[inside]
            x, y = np.split(self.at_ranks(np.r_[some, some + r]), 2)
            good = ~inside
            good[inside] = x + y >= 2 * np.broadcast_to(at[:, None], probes.shape)[inside]
            j = np.where(good.any(axis=1), good.argmax(axis=1), 64)
            pick = lambda k: probes[np.arange(len(at)), k]
            low, high = np.where(j > 0, pick(np.maximum(j, 1) - 1) + 1, low), np.where(j < 64, np.minimum(pick(np.minimum(j, 63)), high), high)
            low = np.minimum(low, high)
        return low

    def cells(self) -> Cells:
        edges, middle, half = borders(self.at_ranks(np.unique(np.linspace(0, self.rows - 1, CELLS + 1).astype(np.int64))), CELLS)
        names = [f"m{k}" for k in range(2 * _POWERS)]

        def sums(t):
            s = t["s"].to_numpy()
            cell = np.clip(np.searchsorted(edges, s, "right") - 1, 0, len(edges) - 1)
            first = np.flatnonzero(np.r_[True, np.diff(cell) > 0])
            x = (s - middle[cell]) / half[cell]
            out = {"cell": cell[first]}
            for base, c in ((0, "n"), (_POWERS, "k")):
                v = t[c].to_numpy(float)
                for q in range(_POWERS):
                    out[names[base + q]] = np.add.reduceat(v, first)
                    v = v * x
            return pd.DataFrame(out)

        got = _by_part(self.df, sums, "cell long, " + ", ".join(f"{c} double" for c in names)).toPandas().groupby("cell").sum().sort_index()
        held = got.index.to_numpy()
        return Cells(middle[held], half[held], got[names].to_numpy().T.copy())

    def reach(self, frac: float, degree: int) -> int:
        return int(min(max(math.ceil(frac * self.rows), degree + 1), self.rows))

    def places(self, at: np.ndarray, frac: float, degree: int = 1) -> np.ndarray:
        """The regression at a few places."""
        r = self.reach(frac, degree)
        first = self.first(at, r)
        lo, hi = np.split(self.at_ranks(np.r_[first, first + r - 1]), 2)
        return self.cells().fits(at, np.maximum(at - lo, hi - at), degree)

    def on_grid(self, frac: float, grid: int) -> DataFrame:
        """s, n, k, w and the regression c, fitted at ``grid`` quantiles and interpolated."""
        anchors = np.unique(self.quantiles(np.linspace(0, 1, grid)))
        fit = self.places(anchors, frac)
        return _by_part(self.df, lambda t: t.assign(c=np.interp(t["s"], anchors, fit))[["s", "n", "k", "w", "c"]], "s double, n double, k double, w double, c double")

    def everywhere(self, frac: float, degree: int = 1) -> DataFrame:
        """s, n, k, w and the regression c at every score: a range gets the stretches its windows begin and end in."""
        r = self.reach(frac, degree)
        parts = self.ranges["part"].tolist()
        ends = np.split(self.first(self.ranges[["low", "high"]].to_numpy().T.ravel(), r), 2)
        bounds = {p: (int(a), int(b)) for p, a, b in zip(parts, *ends)}
        cells, starts = self.df.sparkSession.sparkContext.broadcast(self.cells()), self.starts

        def deal(t):
            upto = starts[int(t["part"].iloc[0])] + np.cumsum(t["n"].to_numpy())
            t = t.assign(kind=0, rank=upto - t["n"].to_numpy())
            out = [t]
            for p, (a, b) in bounds.items():
                for kind, low, high in ((1, a, b), (2, a + r - 1, b + r)):
                    out.append(t[(upto > low) & (t["rank"] <= high)].assign(part=p, kind=kind))
            return pd.concat(out)[["s", "n", "k", "w", "part", "kind", "rank"]]

        def solve(t):
            a, b = bounds[int(t["part"].iloc[0])]
            own, left, right = (t[t["kind"] == kind].sort_values("s") for kind in (0, 1, 2))
            row = lambda side, i: side["s"].to_numpy()[np.searchsorted(side["rank"].to_numpy(), i, "right") - 1]
            s = own["s"].to_numpy()
            steps = np.unique(np.r_[float(a), left["rank"], right["rank"] - r])
            steps = steps[(steps >= a) & (steps < b)]
            first = np.r_[steps, float(b)][np.searchsorted(row(left, steps) + row(right, steps + r), 2 * s, "left")]
            h = np.maximum(s - row(left, first), row(right, first + r - 1) - s)
            return own.assign(c=cells.value.fits(s, h, degree))[["s", "n", "k", "w", "c"]]

        columns = "s double, n double, k double, w double"
        return _by_part(self.df, deal, f"{columns}, part int, kind int, rank double").groupBy("part").applyInPandas(solve, f"{columns}, c double")


def spread_quantiles(df: DataFrame, levels: Sequence[float], weighted: bool, buckets: int = 65_536) -> list[float]:
    """Quantiles of ``a`` over rows (a, n, w): linear between rows that repeat n times or, ``weighted``, at mid-weight positions.

    Sums by ranges of values say which ranges hold the neighbours of a level; only those are put in order."""
    size = F.col("w") if weighted else F.col("n")
    low, high = df.agg(F.min("a"), F.max("a")).first()
    where = F.least(F.floor((F.col("a") - low) / ((high - low) / buckets)), F.lit(buckets - 1)) if high > low else F.lit(0).cast("long")
    df = df.select("a", size.alias("size"), where.alias("bucket"))
    totals = df.groupBy("bucket").agg(F.sum("size").alias("size")).orderBy("bucket").toPandas()
    ends = np.cumsum(totals["size"].to_numpy())
    out = []
    for q in levels:
        at = q * (ends[-1] if weighted else ends[-1] - 1)
        k = int(np.clip(np.searchsorted(ends, at, "right"), 0, len(ends) - 1))
        some = slice(max(k - 1, 0), k + 2)
        got = df.where(F.col("bucket").isin(totals["bucket"].iloc[some].tolist())).toPandas().sort_values("a", kind="stable")
        x, upto = got["a"].to_numpy(), (ends[some.start - 1] if some.start else 0.0) + np.cumsum(got["size"].to_numpy())
        if weighted:
            out.append(float(np.interp(at, upto - got["size"].to_numpy() / 2, x)))
        else:
            a, b = (x[min(np.searchsorted(upto, i, "right"), len(x) - 1)] for i in (math.floor(at), math.ceil(at)))
            out.append(float(a + (b - a) * (at - math.floor(at))))
    return out
