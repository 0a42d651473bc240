"""Kernel calibration error: quadratic and linear estimators, and tests of calibration by them. Weights play no part."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.exprs import logit
from ..session import ship
from .frame import Frame, S, Y, prefixed

#: Operators quadratic by their kernel (gaussian) refuse more distinct pairs of score and outcome than this.
MAX_CLASSES = 20_000
#: The laplace bootstrap test takes more distinct pairs of score and outcome than this range by range on the executors.
TEST_CLASSES = 250_000
#: Distinct pairs of a range that one task holds.
RANGE_CLASSES = 200_000
#: The median distance is taken over this many rows at most, evenly spaced in row order.
MEDIAN_ROWS = 4096
_HEX = 16**8


def _checked(kernel: str, scale: str) -> Column:
    """The kernel's input, once the names are known to be right."""
    if kernel not in ("laplace", "gaussian"):
        raise ValueError("kernel is 'laplace' or 'gaussian'")
    if scale not in ("probability", "logit"):
        raise ValueError("scale is 'probability' or 'logit'")
    return logit(S()) if scale == "logit" else S()


def _near(d: np.ndarray, kernel: str, width: float) -> np.ndarray:
    return np.exp(-d / width) if kernel == "laplace" else np.exp(-0.5 * (d / width) ** 2)


def ranked(df: DataFrame, bucket: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with ``place``, the position from 0 in the order of ``bucket``, then ``order``."""
    return prefixed(df, bucket, order, "place").withColumn("place", F.col("place") - 1)


def _buckets(n: int) -> int:
    return max(1, n // 200_000)


def bandwidth_of(f: Frame, scale: str = "probability") -> float:
    """Median distance between two of at most ``MEDIAN_ROWS`` rows evenly spaced by ``row_id``; the mean if that is 0."""
    x = _checked("laplace", scale)
    n, low, high = f.df.agg(F.count("*"), F.min("row_id"), F.max("row_id")).first()
    rows = f.df.select("row_id", x.alias("x"))
    if n > MEDIAN_ROWS:
        at = F.floor((F.col("row_id") - F.lit(low)) / F.lit(high - low + 1) * F.lit(_buckets(n)))
        rows = ranked(rows, at, ["row_id", "x"]).where(F.col("place") % math.ceil(n / MEDIAN_ROWS) == 0)
    got = rows.select("x").toPandas()["x"].to_numpy(float)
    apart = np.abs(got[:, None] - got)[np.triu_indices(len(got), 1)]
    for width in (np.median(apart), apart.mean()) if len(apart) else ():
        if width > 0:
            return float(width)
    raise ValueError("all scores are identical: give a bandwidth")


def _width(f: Frame, bandwidth: float | None, scale: str) -> float:
    if bandwidth is None:
        return bandwidth_of(f, scale)
    if not (math.isfinite(bandwidth) and bandwidth > 0):
        raise ValueError("bandwidth is positive and finite")
    return float(bandwidth)


def _classes(f: Frame, x: Column, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel input, residual and number of rows for each distinct pair of score and outcome, at most ``rows`` of them."""
    pooled = f.df.groupBy("s", "y").agg(F.count("*").alias("n"))
    got = pooled.select(x.alias("x"), (Y() - S()).alias("r"), "n", "s").orderBy("s", "r").limit(rows + 1).toPandas()
    if len(got) > rows:
        raise ValueError(f"more than {rows} distinct pairs of score and outcome; round the scores first, or take the linear estimator")
    return got["x"].to_numpy(float), got["r"].to_numpy(float), got["n"].to_numpy(float)


def _behind(x: np.ndarray, v: np.ndarray, width: float) -> np.ndarray:
    """For ascending x, at each place the sum of v up to it, each decayed by exp(-distance / width); v may have lanes.

    Decay multiplies along the line, so prefix sums do, inside stretches short enough for the growing factors."""
    out = np.empty_like(v)
    if not len(x):
        return out
    t = (x - x[0]) / width
    ends = np.r_[np.flatnonzero(np.diff(np.floor(t / 500))) + 1, len(x)]
    carry, at, a = np.zeros(v.shape[1:]), 0.0, 0
    for b in ends:
        up = np.exp(t[a:b] - t[a]).reshape(-1, *[1] * (v.ndim - 1))
        out[a:b] = (np.cumsum(v[a:b] * up, axis=0) + carry * math.exp(at - t[a])) / up
        carry, at, a = out[b - 1], t[b - 1], b
    return out


def _laplace_sums(x: np.ndarray, v: np.ndarray, width: float) -> np.ndarray:
    """For ascending x, at each place the sum of all v by the laplace kernel, in linear time."""
    return _behind(x, v, width) + _behind(-x[::-1], v[::-1], width)[::-1] - v


def _stretch(x: np.ndarray, r: np.ndarray, n: np.ndarray, width: float) -> dict[str, float]:
    """What a stretch of the line hands on: its ends, its residuals decayed to both ends, its pair sum, its squares, its rows."""
    v = n * r
    right, left = _behind(x, v, width), _behind(-x[::-1], v[::-1], width)
    return {
        "first": float(x[0]), "last": float(x[-1]), "left": float(left[-1]), "right": float(right[-1]),
        "pairs": math.fsum(v * (2 * right - v)), "own": math.fsum(n * r * r), "n": float(n.sum()),
    }


def _joined(a: dict[str, float], b: dict[str, float], width: float) -> dict[str, float]:
    """Two neighbouring stretches, ``a`` before ``b``, as one."""
    return {
        "first": a["first"], "last": b["last"],
        "left": a["left"] + b["left"] * math.exp((a["first"] - b["first"]) / width),
        "right": b["right"] + a["right"] * math.exp((a["last"] - b["last"]) / width),
        "pairs": a["pairs"] + b["pairs"] + 2 * a["right"] * b["left"] * math.exp((a["last"] - b["first"]) / width),
        "own": a["own"] + b["own"], "n": a["n"] + b["n"],
    }


def _laplace_pairs(f: Frame, x: Column, width: float) -> tuple[float, float, float]:
    """Laplace kernel sum over all ordered pairs of rows, self pairs included; the sum of squared residuals; the number of rows.

    Classes are range-sorted by score; a task reads its range in batches and hands on one stretch, and the stretches, one for each
    partition, are joined in order. Any number of rows and of distinct scores will do."""
    pooled = f.df.groupBy("s", "y").agg(F.count("*").cast("double").alias("n"))
    rows = pooled.repartitionByRange("s").sortWithinPartitions("s").select(x.alias("x"), (Y() - S()).alias("r"), "n")
    names = ["first", "last", "left", "right", "pairs", "own", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if batch.num_rows:
                new = _stretch(*[batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], width)
                done = new if done is None else _joined(done, new, width)
        if done is not None:
            yield pa.RecordBatch.from_pylist([done], schema=pa.schema([(c, pa.float64()) for c in names]))

    parts = sorted((r.asDict() for r in rows.mapInArrow(run, ", ".join(f"{c} double" for c in names)).collect()), key=lambda p: p["first"])
    if not parts:
        return 0.0, 0.0, 0.0
    done = parts[0]
    for part in parts[1:]:
        done = _joined(done, part, width)
    return done["pairs"], done["own"], done["n"]


def _row_sums(x: np.ndarray, r: np.ndarray, n: np.ndarray, kernel: str, width: float) -> np.ndarray:
    """For each class the sum of its pair terms with every row, itself included."""
    if kernel == "laplace":
        return 2 * r * _laplace_sums(x, n * r, width)
    return np.concatenate([2 * r[a : a + 512] * (_near(np.abs(x[a : a + 512, None] - x), kernel, width) @ (n * r)) for a in range(0, len(x), 512)])


def skce(f: Frame, bandwidth: float | None = None, biased: bool = False, rows: int = MAX_CLASSES, kernel: str = "laplace", scale: str = "probability") -> float:
    """Kernel calibration error over all pairs: the product of the residuals times twice the kernel, on average.

    Rows alike in score and outcome are one class (a grouped count). The laplace kernel takes one pass over the range-sorted classes,
    on the executors and for any number of rows. The gaussian is quadratic in the classes, which ``rows`` bounds, and runs on
    the driver. ``biased`` counts a row's pair with itself."""
    x = _checked(kernel, scale)
    if f.df.limit(2).count() < 2:
        raise ValueError("at least 2 rows are needed")
    width = _width(f, bandwidth, scale)
    if kernel == "laplace":
        pairs, own, total = _laplace_pairs(f, x, width)
    else:
        at, r, n = _classes(f, x, rows)
        pairs, own, total = float(n @ _row_sums(at, r, n, kernel, width)) / 2, float(n @ (r * r)), n.sum()
    return 2 * pairs / total**2 if biased else 2 * (pairs - own) / (total * (total - 1))


def linear_terms(f: Frame, width: float, kernel: str = "laplace", scale: str = "probability", seed: int = 42) -> DataFrame:
    """One ``term`` for each of the disjoint pairs that neighbours in a shuffled order form; a last odd row has none.

    The order is that of the md5 of ``row_id`` and ``seed``. Linear in the rows and distributed throughout."""
    x = _checked(kernel, scale)
    turn = F.md5(F.concat(F.col("row_id").cast("string"), F.lit(f":{seed}")))
    rows = f.df.select("row_id", x.alias("x"), (Y() - S()).alias("r"), turn.alias("turn"))
    at = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * F.lit(_buckets(f.df.count())) / F.lit(_HEX))
    pairs = ranked(rows, at, ["turn", "row_id", "x", "r"]).groupBy(F.floor(F.col("place") / 2).alias("pair"))
    pairs = pairs.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("d"), F.min_by("r", "place").alias("a"), F.max_by("r", "place").alias("b")).where("n = 2")
    d = F.col("d") / F.lit(width)
    return pairs.select("pair", (2 * F.exp(-d if kernel == "laplace" else -0.5 * d * d) * F.col("a") * F.col("b")).alias("term"))


def skce_linear(f: Frame, bandwidth: float | None = None, kernel: str = "laplace", scale: str = "probability", seed: int = 42) -> DataFrame:
    """Number of pairs, mean (the unbiased linear estimate) and standard deviation of the pair terms: one row."""
    terms = linear_terms(f, _width(f, bandwidth, scale), kernel, scale, seed)
    return terms.agg(F.count("*").alias("pairs"), F.avg("term").alias("skce"), F.stddev_samp("term").alias("sd"))


def _bound(statistic: float, n: int) -> float:
    """A p-value no distribution exceeds: pair terms lie within a range of 4, and n // 2 of them are independent."""
    return 1.0 if statistic <= 0 else math.exp(-(n // 2) * statistic**2 / 8)


def _resampled(f: Frame, x: np.ndarray, r: np.ndarray, n: np.ndarray, kernel: str, width: float, replicates: int, seed: int) -> np.ndarray:
    """Centred quadratic statistics of multinomial resamples: one task for a slice of replicates and, where the kernel is
    quadratic, a block of classes. The more classes, the fewer replicates a slice has, so a task's memory is bounded.

    Each task draws its slice's counts from the seed and the slice's number, so a task that runs again gives the same."""
    total, lanes = n.sum(), min(128, max(1, 2_560_000 // len(x)))
    rows = len(x) if kernel == "laplace" else 2048
    sums = _row_sums(x, r, n, kernel, width) / total
    middle = float(n @ sums / total)
    own = 2 * r * r - 2 * sums + middle
    blocks, slices = -(-len(x) // rows), -(-replicates // lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                block, part = divmod(task, slices)
                size = min(lanes, replicates - part * lanes)
                drawn = np.random.default_rng([seed, part]).multinomial(int(total), n / total, size=size).T.astype(float)
                if kernel == "laplace":
                    near = 2 * r[:, None] * _laplace_sums(x, r[:, None] * drawn, width)
                    value = (drawn * (near - (2 * total * sums + own)[:, None])).sum(axis=0)
                else:
                    value = np.zeros(size)
                    for a in range(block * rows, min(len(x), (block + 1) * rows), 256):
                        b = min(a + 256, (block + 1) * rows)
                        near = 2 * r[a:b, None] * (_near(np.abs(x[a:b, None] - x), kernel, width) @ (r[:, None] * drawn))
                        value += (drawn[a:b] * (near - (2 * total * sums + own)[a:b, None])).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size) + part * lanes), pa.array(value)], names=["replicate", "value"])

    spark = f.df.sparkSession
    got = spark.range(0, blocks * slices, 1, min(blocks * slices, 512)).mapInArrow(run, "replicate long, value double")
    parts = got.groupBy("replicate").agg(F.sort_array(F.collect_list("value")).alias("v")).orderBy("replicate").collect()
    return (np.array([math.fsum(p["v"]) for p in parts]) + total**2 * middle) / total


def _resampled_near(f: Frame, x: Column, kernel: str, rows: int, width: float, replicates: int, seed: int) -> tuple[float, np.ndarray]:
    """The statistic, and its centred form in resamples, with all classes on the driver."""
    xs, r, n = _classes(f, x, TEST_CLASSES if kernel == "laplace" else rows)
    total = n.sum()
    statistic = float(n @ (_row_sums(xs, r, n, kernel, width) - 2 * r * r) / (total * (total - 1)))
    return statistic, _resampled(f, xs, r, n, kernel, width, replicates, seed)


def _resampled_far(f: Frame, x: Column, classes: int, width: float, replicates: int, seed: int) -> tuple[float, np.ndarray]:
    """The laplace statistic, and its centred form in multinomial resamples, with the classes left in range-sorted partitions.

    The driver deals each resample's rows over the partitions, a partition draws its own, and hands on for each resample what a
    stretch of the line hands on, and its share of the centring; the stretches are joined in order."""
    ship(f.df.sparkSession)
    pooled = f.df.groupBy("s", "y").agg(F.count("*").alias("n"))
    rows = pooled.repartitionByRange(max(1, -(-classes // RANGE_CLASSES)), "s").sortWithinPartitions("s", "y")
    rows = rows.select(x.alias("x"), (Y() - S()).alias("r"), F.col("n").cast("double").alias("n"), F.spark_partition_id().alias("part")).persist()
    names = ["first", "last", "left", "right", "pairs", "own", "n"]

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[np.ndarray]] | None:
        held = [b for b in batches if b.num_rows]
        return (held[0].column(3)[0].as_py(), [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3)]) if held else None

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := whole(batches):
            yield pa.RecordBatch.from_pylist([{"part": got[0], **_stretch(*got[1], width)}], schema=pa.schema([("part", pa.int32()), *[(c, pa.float64()) for c in names]]))

    parts = sorted((r.asDict() for r in rows.mapInArrow(stretches, "part int, " + ", ".join(f"{c} double" for c in names)).collect()), key=lambda p: p["first"])
    done = parts[0]
    for p in parts[1:]:
        done = _joined(done, p, width)
    total = done["n"]
    statistic, middle = 2 * (done["pairs"] - done["own"]) / (total * (total - 1)), 2 * done["pairs"] / total**2
    # what reaches each stretch's first point from those before, and its last point from those after
    reach = {p["part"]: [0.0, 0.0] for p in parts}
    for a, b in zip(parts, parts[1:]):
        reach[b["part"]][0] = (a["right"] + reach[a["part"]][0] * math.exp((a["first"] - a["last"]) / width)) * math.exp((a["last"] - b["first"]) / width)
    for a, b in reversed(list(zip(parts, parts[1:]))):
        reach[a["part"]][1] = (b["left"] + reach[b["part"]][1] * math.exp((b["first"] - b["last"]) / width)) * math.exp((a["last"] - b["first"]) / width)
    shares = np.random.default_rng([seed, 0]).multinomial(int(total), np.array([p["n"] for p in parts]) / total, size=replicates)
    sizes = {p["part"]: shares[:, i] for i, p in enumerate(parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = whole(batches)
        if not got:
            return
        part, (at, r, n) = got
        down, up = np.exp((at[0] - at) / width), np.exp((at - at[-1]) / width)
        sums = 2 * r * (_laplace_sums(at, n * r, width) + reach[part][0] * down + reach[part][1] * up) / total
        centre = 2 * total * sums + 2 * r * r - 2 * sums + middle
        rows_ = int(n.sum())
        of = np.repeat(np.arange(len(n)), n.astype(int)) if rows_ <= 4 * len(n) else None
        for a in range(0, replicates, 16):
            lanes = range(a, min(a + 16, replicates))
            drawn = np.empty((len(n), len(lanes)))
            for j, number in enumerate(lanes):
                rng, size = np.random.default_rng([seed, 1, part, number]), int(sizes[part][number])
                drawn[:, j] = rng.multinomial(size, n / n.sum()) if of is None else np.bincount(of[rng.integers(0, rows_, size)], minlength=len(n))
            v = r[:, None] * drawn
            right = _behind(at, v, width)
            out = [(v * down[:, None]).sum(axis=0), right[-1], (v * (2 * right - v)).sum(axis=0), centre @ drawn]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(lanes), pa.int32()), pa.array(list(lanes), pa.int32()), *[pa.array(c) for c in out]], names=["part", "replicate", "left", "right", "pairs", "centre"])

    got = rows.mapInArrow(run, "part int, replicate int, left double, right double, pairs double, centre double").toPandas().sort_values("replicate")
    rows.unpersist()
    each = {int(k): {c: t[c].to_numpy() for c in ("left", "right", "pairs", "centre")} for k, t in got.groupby("part")}
    lanes, centring = None, 0.0
    for p in parts:
        own = each[p["part"]]
        new = {"first": p["first"], "last": p["last"], "left": own["left"], "right": own["right"], "pairs": own["pairs"], "own": 0.0, "n": 0.0}
        lanes, centring = new if lanes is None else _joined(lanes, new, width), centring + own["centre"]
    return statistic, (2 * lanes["pairs"] - centring + total**2 * middle) / total


def skce_test(
    f: Frame, method: str = "bootstrap", replicates: int = 999, bandwidth: float | None = None, kernel: str = "laplace", scale: str = "probability", seed: int = 42, rows: int = MAX_CLASSES
) -> dict:
    """One-sided test of calibration: statistic, estimator, method, p_value, p_value_bound, bandwidth, replicates.

    ``asymptotic``: the linear estimate over its standard error against the normal law; fit for any number of rows.
    ``bootstrap``: the quadratic estimate against resamples of its centred form; stronger; fit for any number of rows with the laplace
    kernel, and bounded by ``rows`` distinct pairs of score and outcome with the gaussian."""
    if method not in ("bootstrap", "asymptotic"):
        raise ValueError("method is 'bootstrap' or 'asymptotic'")
    if replicates < 1:
        raise ValueError("at least 1 replicate is needed")
    x = _checked(kernel, scale)
    count = f.df.count()
    if count < 4:
        raise ValueError("at least 4 rows are needed")
    width = _width(f, bandwidth, scale)
    if method == "asymptotic":
        got = skce_linear(f, width, kernel, scale, seed).first()
        statistic, sd = got["skce"], got["sd"]
        p = special.norm_cdf(-math.sqrt(got["pairs"]) * statistic / sd) if sd > 0 else float(statistic <= 0)
    else:
        classes = f.df.select("s", "y").distinct().count() if kernel == "laplace" else 0
        if classes > TEST_CLASSES:
            statistic, drawn = _resampled_far(f, x, classes, width, replicates, seed)
        else:
            statistic, drawn = _resampled_near(f, x, kernel, rows, width, replicates, seed)
        p = (1 + int((drawn >= count * statistic).sum())) / (replicates + 1)
    return {
        "statistic": statistic,
        "estimator": "uq" if method == "bootstrap" else "ul",
        "method": method,
        "p_value": float(p),
        "p_value_bound": _bound(statistic, count),
        "bandwidth": width,
        "replicates": replicates if method == "bootstrap" else 0,
    }
