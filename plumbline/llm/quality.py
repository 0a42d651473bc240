"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, remainder, sample_key, short_batches, text_bytes, words

_CLASS = np.full(256, 6, np.uint8)  # other signs
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, *range(9, 14)), range(128, 256), b".,;:'\"()-?")):
    _CLASS[list(_set)] = _k
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "blank", "beyond_ascii", "stops", "signs",
    "distinct_words", "log_lines", "line_bytes", "repeated_lines", "repeated_line_bytes", "words_with_signs", "sentences", "bars", "longest_word",
)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text, from its bytes, whole words and whole lines; empty texts are all zero."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((rows, len(FEATURES)))
    if not len(data):
        return out
    kind = _CLASS[data]

    def total(flags: np.ndarray) -> np.ndarray:
        summed = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=summed[1:])
        return np.diff(summed[offsets]).astype(float)

    hashes, starts, ends, first = words(data, offsets)
    count = np.diff(first).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(first))
    distinct = np.unique(hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(owner[distinct], minlength=rows)
    signed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 6, out=signed[1:])
    with_signs = np.bincount(owner, weights=(signed[ends] > signed[starts]).astype(float), minlength=rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, (ends - starts).astype(float))

    # lines: a line's hash is the order-bound sum of its words' hashes
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    lines = np.diff(breaks[offsets]).astype(float) + (size > 0)
    if len(hashes):
        line = breaks[starts] + owner  # a new row begins a new line
        new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        place = np.arange(len(hashes)) - np.repeat(new, np.diff(np.r_[new, len(hashes)]))
        joined = np.add.reduceat(mix64(hashes + place.astype(np.uint64)), new)
        width = (ends[np.r_[new[1:], len(hashes)] - 1] - starts[new]).astype(float)
        at = owner[new]
        _, back, times = np.unique(joined ^ mix64(at.astype(np.uint64) + np.uint64(7)), return_inverse=True, return_counts=True)
        again = times[back] > 1
        texted = np.bincount(at, minlength=rows).astype(float)
        repeated = np.bincount(at, weights=again.astype(float), minlength=rows)
        repeated_bytes = np.bincount(at, weights=np.where(again, width, 0.0), minlength=rows)
    else:
        texted = repeated = repeated_bytes = np.zeros(rows)
    safe, safe_words = np.maximum(size, 1), np.maximum(count, 1)
    sums = [total(kind == k) for k in range(7)]
    stops = total((data == 46) | (data == 33) | (data == 63))
    columns = (
        np.log1p(size), np.log1p(count), (size - sums[3]) / safe_words, *(s / safe for s in sums), distinct / safe_words, np.log1p(lines), size / np.maximum(lines, 1),
        repeated / np.maximum(texted, 1), repeated_bytes / safe, with_signs / safe_words, stops / safe_words, total(data == 124) / safe_words, longest,
    )
    out[:] = np.stack(columns, axis=1)
    out[size == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Bin edges, a lookup table for each feature, and a table for each pair of features (on coarser bins)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Additions of looked-up bins; nothing else happens at scoring time."""
        z = np.full(len(x), self.intercept)
        if self.tables:
            bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
            for table, b in zip(self.tables, bins):
                z += table[b]
            wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
            for (a, b), table in self.pairs.items():
                z += table[wide[a], wide[b]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def _leaf(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> np.ndarray:
    return gradient / (hessian + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The best tree of three leaves over ordered bins, as the value of each bin."""

    def split(lo: int, hi: int) -> tuple[float, int]:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return 0.0, lo
        ta, tb = g[lo:hi].sum(), h[lo:hi].sum()
        gain = a * a / (b + ridge) + (ta - a) ** 2 / (tb - b + ridge) - ta * ta / (tb + ridge)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    cuts = [0, len(g)]
    for _ in range(2):
        options = [split(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        gain, at = max(options)
        if gain <= 1e-9:
            break
        cuts = sorted({*cuts, at})
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum(), ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree of depth two (one cut on each of two features), as a value grid, and its gain."""
    ag, ah = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = g.shape
    best, where = 0.0, None
    tg, th = ag[-1, -1], ah[-1, -1]
    for i in range(rows - 1):
        g1, h1 = ag[i, :-1], ah[i, :-1]
        g2, h2 = ag[i, -1] - g1, ah[i, -1] - h1
        g3, h3 = ag[-1, :-1] - g1, ah[-1, :-1] - h1
        g4, h4 = tg - g1 - g2 - g3, th - h1 - h2 - h3
        gain = sum(a * a / (b + ridge) for a, b in ((g1, h1), (g2, h2), (g3, h3), (g4, h4))) - tg * tg / (th + ridge)
        if len(gain) and gain.max() > best:
            best, where = float(gain.max()), (i + 1, int(gain.argmax()) + 1)
    out = np.zeros_like(g)
    if where:
        i, j = where
        for r in (slice(0, i), slice(i, rows)):
            for c in (slice(0, j), slice(j, cols)):
                out[r, c] = _leaf(g[r, c].sum(), h[r, c].sum(), ridge)
    return out, best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 30, rate: float = 0.15, bins: int = 32, coarse: int = 8, pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Fit by cyclic boosting: one small tree for each feature in turn, round after round, added to the feature's table;
    then the pairs whose grids explain most of what is left are boosted the same way."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return model
    width = x.shape[1]

    def cuts(values: np.ndarray, k: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.linspace(0, 1, k + 1)[1:-1]))

    model.edges = [cuts(x[:, j], bins) for j in range(width)]
    model.coarse = [cuts(x[:, j], coarse) for j in range(width)]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(fine[j], g, k), np.bincount(fine[j], h, k), ridge)
            model.tables[j] += step
            z += step[fine[j]]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return np.bincount(wide[a] * shape[1] + wide[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), ridge)[1], a, b) for a, b in combinations(range(width), 2)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[:pairs] if gain > 1e-6]
    model.pairs = {p: np.zeros((len(model.coarse[p[0]]) + 1, len(model.coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            g, h = slopes()
            step = rate * _pair_tree(grid(a, b, g), grid(a, b, h), ridge)[0]
            model.pairs[a, b] += step
            z += step[wide[a], wide[b]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 12_000, **options) -> AdditiveModel:
    """Fit on a bounded sample: at most ``rows`` labelled rows whose crc32(doc_id) mod 3 is not 1, by a hash of the id.

    Their whole texts are read by the executors; the driver gets one row of features each. Rows without
    a label are left out; one class alone, or fewer than ten rows, gives the base rate.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = ids.where(remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = ids.orderBy(sample_key(F.col("doc_id"), "quality")).limit(rows)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted(((r["doc_id"], r["quality"], tuple(r["x"])) for r in sample.mapInArrow(run, "doc_id long, quality int, x array<double>").collect()))
    if not got:
        return AdditiveModel(0.0)
    return boost(np.array([g[2] for g in got]), np.array([g[1] for g in got], float), **options)


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; the text alone makes the score.

    Edge cases: null and empty texts have features of zero and are scored like any; repeated rows are scored
    one by one; an empty table gives no rows; further columns are ignored.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = model.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
