"""Toxicity by compression distance: two zstandard dictionaries, window lengths compared, thresholds calibrated."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, remainder, sample_key, short_batches

_FOLD = bytes.maketrans(bytes(range(256)), bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)))
#: Content that ends both dictionaries and begins each window: a window's block is then always coded
#: by matches and never stored raw, so that single short matches count.
_MARK = b"@" + bytes(range(1, 24)) + b"@"
#: Differences, in bytes, from which windows are counted.
STEPS = (1, 2, 3, 4, 5, 6, 8)
#: Length of the stretches by which toxic text is held against ordinary text before training.
GRAM = 6


def fold(text: str) -> bytes:
    """Lower-cased letters, and single blanks for everything else in ASCII."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def windows(folded: bytes, width: int) -> list[bytes]:
    """Pieces of at least ``width`` bytes that begin and end at a blank; together they are the whole text."""
    out, start, end = [], 0, len(folded)
    while start < end:
        stop = folded.find(b" ", start + width)
        stop = end if stop < 0 else stop
        out.append(b" " + folded[start:stop] + b" ")
        start = stop + 1
    return out


def _grams(text: bytes) -> np.ndarray:
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(x) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = out * np.uint64(256) + x[k : k + n]
    return out


def _novel(text: bytes, common: np.ndarray) -> list[bytes]:
    """The distinct stretches of a text none of whose grams is common."""
    grams = _grams(text)
    if not len(grams):
        return []
    new = np.ones(len(grams), bool)
    if len(common):
        new = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] != grams
    edge = np.flatnonzero(np.diff(np.r_[0, new.astype(np.int8), 0]))
    return list(dict.fromkeys(text[i : j + GRAM - 1] for i, j in zip(edge[::2], edge[1::2])))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """What zstandard's trainer makes of the samples, or the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(toxic: Sequence[str], ordinary: Sequence[str], width: int = 8, toxic_size: int = 4096, ordinary_size: int = 32_768, rate: float = 0.001) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, both as zstandard's trainer returns them.

    The ordinary one is trained on all windows of the ordinary texts. The toxic one is trained on what ordinary text leaves of the toxic
    texts: the stretches whose grams are in at most ``rate`` of the ordinary texts (one text is always allowed). The trainer
    keeps what recurs among these.
    """
    plain = [b" " + fold(t) + b" " for t in ordinary]
    if not any(map(str.strip, toxic)) or not any(map(str.strip, ordinary)):
        return b"", b""
    grams, count = np.unique(np.concatenate([np.unique(_grams(t)) for t in plain]), return_counts=True)
    common = grams[count > max(1, rate * len(plain))]
    marked = [s for t in toxic for s in _novel(b" " + fold(t) + b" ", common)]
    if not marked:
        return b"", b""
    return _trained(toxic_size, marked), _trained(ordinary_size, [w for t in plain for w in windows(t.strip(), width)])


def _lengths(content: bytes):
    """A function from windows to their compressed lengths under a dictionary."""
    content = content + _MARK
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(3, source_size=48, dict_size=len(content), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    data.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(compression_params=how, dict_data=data).compress
    return lambda window: len(compress(_MARK + window))


@dataclass
class ToxicityModel:
    """Two dictionaries, the window width, and a logistic calibration of window counts."""

    toxic: bytes
    ordinary: bytes
    width: int
    intercept: float
    weights: tuple[float, ...]

    def counter(self):
        """A function from texts to window counts; made once a worker, as compressors can't be sent."""
        if not self.toxic:
            return lambda texts: np.zeros((len(texts), len(STEPS) + 1))
        hot, cold = _lengths(self.toxic), _lengths(self.ordinary)
        gains: dict[bytes, int] = {}  # of windows met before; emptied when it is full

        def count(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), len(STEPS) + 1))
            for row, text in enumerate(texts):
                found = windows(fold(text), self.width)
                own = []
                for w in found:
                    gain = gains.get(w)
                    if gain is None:
                        gain = cold(w) - hot(w)
                        if len(w) < 64:  # most windows; a text without blanks is one long window
                            if len(gains) >= 1 << 18:
                                gains.clear()
                            gains[w] = gain
                    if gain > 0:
                        own.append(gain)
                for k, step in enumerate(STEPS):
                    out[row, k] = sum(g >= step for g in own)
                out[row, -1] = len(found)
            return out

        return count

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(counts), 1 / (1 + math.exp(-self.intercept)))
        z = np.clip(self.intercept + _features(counts) @ np.asarray(self.weights), -35, 35)
        return 1 / (1 + np.exp(-z))


def _features(counts: np.ndarray) -> np.ndarray:
    """Windows by step (log scale), whether there are any, and their rate."""
    some = counts[:, :-1]
    rate = some / np.maximum(counts[:, -1:], 1)
    return np.hstack([np.log1p(some), some > 0, np.sqrt(rate), np.log1p(counts[:, -1:])]).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2400, ordinary_rows: int = 4800, longest: int = 20_000, width: int = 8) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 4 is not 2.

    At most ``toxic_rows`` and ``ordinary_rows`` rows with texts of at most ``longest`` characters go to the
    driver, chosen by a hash of the id; alternate rows train the dictionaries and the calibration.
    Of texts that share an id the least counts. Rows without label or text are left out; without rows of both classes the score is the base rate.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(remainder(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = ids.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = share["n"] or 0, share["t"] or 0
    key = sample_key(F.col("doc_id"), "toxicity")
    chosen = ids.where("toxic = 1").orderBy(key).limit(toxic_rows).unionByName(ids.where("toxic = 0").orderBy(key).limit(ordinary_rows))
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, longest)).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(key).collect()
    hot, cold = [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]
    prior = math.log((t + 0.5) / (n - t + 0.5))
    content = train_dictionaries(hot[::2], cold[::2], width)
    model = ToxicityModel(*content, width, prior, ())
    if not content[0] or len(hot) < 4 or len(cold) < 4:
        return model
    x = model.counter()(hot[1::2] + cold[1::2])
    y = np.r_[np.ones(len(hot[1::2])), np.zeros(len(cold[1::2]))]
    beta = _logistic(_features(x), y)
    sampled = math.log(len(hot[1::2]) / len(cold[1::2]))
    return ToxicityModel(*content, width, float(beta[0]) + prior - sampled, tuple(map(float, beta[1:])))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, hot_windows for each row; the text alone makes the score.

    Edge cases: null and empty texts have no window and get the calibrated score of none; repeated rows are
    scored one by one; an empty table gives no rows; further columns are ignored.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model.counter()
        for batch in pieces(batches):
            counts = count([t or "" for t in batch.column("text").to_pylist()])
            score = model.score(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(counts[:, 0].astype(np.int64))],
                names=["doc_id", "held_out", "score", "predicted", "hot_windows"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hot_windows long")
