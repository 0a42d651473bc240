"""The calibration frame: validated scores, outcomes, weights and row ids of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clipped

#: Operators that need all distinct scores in order on one machine refuse more than this.
MAX_POINTS = 2_000_000


class TooManyPoints(ValueError):
    """More distinct scores than ``MAX_POINTS``."""


def S() -> Column:
    """The score column; a function, as columns need a session and modules are imported without one."""
    return F.col("s")


def Y() -> Column:
    return F.col("y")


def W() -> Column:
    return F.col("w")


def prefixed(df: DataFrame, bucket: Column, order: Sequence[str], out: str, value: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``, for each ``by`` the running sum of ``value`` (of 1, if none) in the order of ``bucket``, then ``order``.

    Sums by bucket give each bucket its start, and rows are added up inside buckets, so no task holds all rows of a key."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", F.lit(1) if value is None else value)
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_n"))
    starts = totals.select(*by, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_inside", F.sum("_value").over(inside)).join(starts, [*by, "_bucket"])
    return df.withColumn(out, F.col("_inside") + F.col("_start")).drop("_bucket", "_value", "_inside", "_start")


@dataclass(frozen=True)
class Frame:
    """Columns row_id, s (clipped score), y (0/1 double), w (positive double), and any ``by`` columns."""

    df: DataFrame
    weighted: bool = False
    by: tuple[str, ...] = ()

    @classmethod
    def bind(cls, df: DataFrame, score: str = "s", label: str = "y", weight: str | None = None, row_id: str = "row_id", by: Sequence[str] = (), strict: bool = True) -> Frame:
        """Select and check the columns. With ``strict`` one job looks for nulls, non-finite or out-of-range scores,
        labels other than 0 and 1, a label that has one class only, and weights that aren't positive."""
        s, y = F.col(score).cast("double"), F.col(label).cast("double")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        names = [row_id] if row_id in df.columns else []
        if strict:
            bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
            got = df.agg(
                bad(s.isNull() | F.isnan(s) | ~s.between(0, 1)).alias("scores"), bad(y.isNull() | ~y.isin(0.0, 1.0)).alias("labels"),
                bad(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf"))).alias("weights"), F.min(y).alias("low"), F.max(y).alias("high"),
            ).first()
            if got["scores"]:
                raise ValueError(f"{got['scores']} scores are null, non-finite or outside [0, 1]")
            if got["labels"]:
                raise ValueError(f"{got['labels']} labels are neither 0 nor 1")
            if got["weights"]:
                raise ValueError(f"{got['weights']} weights are not finite and strictly positive")
            if got["low"] == got["high"]:
                raise ValueError("outcomes of both classes are needed")
        return cls(df.select(*names, *by, clipped(s).alias("s"), y.alias("y"), w.alias("w")), weight is not None, tuple(by))

    def agg(self, *columns: Column) -> DataFrame:
        return self.df.groupBy(*self.by).agg(*columns) if self.by else self.df.agg(*columns)

    def edges(self, bins: int, strategy: str = "mass", column: str = "s") -> list[float]:
        """Interior edges: distinct exact quantiles (weights play no part), or equal widths."""
        if strategy == "width":
            return [k / bins for k in range(1, bins)]
        if strategy != "mass":
            raise ValueError("strategy is 'mass' or 'width'")
        if bins < 2:
            return []
        return sorted(set(self.quantiles([k / bins for k in range(1, bins)], column)))

    def quantiles(self, levels: Sequence[float], column: str = "s") -> list[float]:
        """Exact quantiles, linear between the two rows around a level.

        Rows are counted by value, counts by a thousand ranges of values give each range its first rank, and only ranges that hold
        a wanted rank are put in order, each in its own task; so no task holds all values."""
        counts = self.df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
        span = self.df.agg(F.min(column), F.max(column)).first()
        low, width = span[0], (span[1] - span[0]) / 1024
        where = F.least(F.floor((F.col("v") - low) / width), F.lit(1023)) if width > 0 else F.lit(0).cast("long")
        counts = counts.withColumn("bucket", where)
        totals = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
        buckets = np.array(sorted(totals))
        ends = np.cumsum([totals[b] for b in buckets])
        at = np.asarray(levels, float) * (ends[-1] - 1)
        ranks = np.unique(np.r_[np.floor(at), np.ceil(at)].astype(np.int64))
        own = np.searchsorted(ends, ranks, "right")
        asked: dict[int, list[int]] = {}
        for rank, k in zip(ranks.tolist(), own.tolist()):
            asked.setdefault(int(buckets[k]), []).append(rank - int(ends[k - 1] if k else 0))

        def pick(batches):
            import pandas as pd

            held: dict[int, list] = {}
            for t in batches:
                for b, part in t.groupby("bucket"):
                    held.setdefault(int(b), []).append(part)
            for b, parts in held.items():
                part = pd.concat(parts).sort_values("v")
                upto = part["n"].cumsum().to_numpy()
                yield pd.DataFrame({"bucket": b, "rank": asked[b], "v": part["v"].to_numpy()[np.searchsorted(upto, asked[b], "right")]})

        wanted = counts.where(F.col("bucket").isin(list(asked))).repartition("bucket")
        rows = wanted.mapInPandas(pick, "bucket long, rank long, v double").collect()  # one row for each wanted rank
        first = {int(b): int(e - totals[b]) for b, e in zip(buckets, ends)}
        value = {first[r["bucket"]] + r["rank"]: r["v"] for r in rows}
        lo, hi = np.floor(at).astype(np.int64).tolist(), np.ceil(at).astype(np.int64).tolist()
        return [value[i] + (value[j] - value[i]) * (x - i) for x, i, j in zip(at.tolist(), lo, hi)]

    def cells(self, edges: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of w, w s and w y between neighbouring edges (right-closed lookup): one aggregate for any number of edges."""
        edges = np.asarray(edges, float)

        def run(batches):
            for t in batches:
                yield t.assign(cell=np.searchsorted(edges, t["s"], "right"))[["cell", "w", "ws", "wy"]]

        pooled = self.df.groupBy("s").agg(F.sum("w").alias("w"), F.sum(W() * S()).alias("ws"), F.sum(W() * Y()).alias("wy"))
        rows = pooled.mapInPandas(run, "cell int, w double, ws double, wy double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("w", "ws", "wy")]).collect()
        out = np.zeros((3, len(edges) + 1))
        for r in rows:
            out[:, r["cell"]] = r["w"], r["ws"], r["wy"]
        return out[0], out[1], out[2]

    def pooled(self) -> dict[str, np.ndarray]:
        """Distinct scores in order with counts, weights, weighted outcomes and plain outcomes: what sequential fits need.

        One grouped aggregate; only distinct scores reach the driver, at most ``MAX_POINTS`` of them."""
        rows = self.df.groupBy("s").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("y").alias("k"))
        if rows.count() > MAX_POINTS:
            raise TooManyPoints(f"more than {MAX_POINTS} distinct scores; round them first")
        got = rows.orderBy("s").toPandas()
        return {c: got[c].to_numpy(float) for c in got.columns}


def merged(edges: np.ndarray, some: np.ndarray, sums: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Sums over cells between ``edges``, added up to the bins between ``some`` of them."""
    starts = np.r_[0, np.searchsorted(edges, some) + 1]
    return [np.add.reduceat(np.r_[x, 0.0], starts) for x in sums]
