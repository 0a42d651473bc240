"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, pieces, remainder, sample_key, short_batches

#: Language value of texts without a letter.
UNDETERMINED = "und"
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return _LETTER


def ngrams(texts: Sequence[str], n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the folded texts, the row of each, and which rows have a letter.

    Texts are lower-cased; a run of other characters is one blank. A window counts if no blank is inside it.
    """
    is_letter = _letters()
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " \n ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    row = np.repeat(np.arange(len(lowered)), sizes + 3)[: len(codes)]
    letter = is_letter[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    codes, row, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    has = np.zeros(len(lowered), bool)
    has[row[letter]] = True
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    count = len(codes) - n + 1
    middle = np.ones(count, bool)
    value = np.zeros(count, np.uint64)
    for k in range(n):
        value = value * np.uint64(0x100000001B3) + codes[k : k + count] + np.uint64(1)
        if 0 < k < n - 1 or n < 3:
            middle &= letter[k : k + count]
    return mix64(value[middle]), row[n // 2 : n // 2 + count][middle], has


@dataclass
class LanguageModel:
    """Bit-sliced Bloom filters: row i of ``slices`` holds bit i of every language's filter."""

    languages: list[str]
    slices: np.ndarray = field(repr=False)
    hashes: int
    n: int

    @property
    def false_rate(self) -> np.ndarray:
        """Chance, by language, that an n-gram that was not put in is answered yes: fill to the power of the hashes."""
        bits = (self.slices[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        fill = bits.mean(axis=0).reshape(-1)[: len(self.languages)]
        return np.minimum(fill**self.hashes, 0.99)

    def positions(self, keys: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(len(self.slices))
        first, second = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        return [((first + np.uint64(k) * second) % size).astype(np.int64) for k in range(self.hashes)]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that contain it (one uint64 for each 64 languages)."""
        first, *rest = self.positions(keys)
        mask = self.slices[first]
        for at in rest:
            mask = mask & self.slices[at]
        return mask

    def decide(self, texts: Sequence[str], fill: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        The hits of a language, less those that its false positive rate explains, estimate how many of the
        text's n-grams it contains; the best estimate decides, ties by language order. The score is that
        estimate's share against the second, sharpened by the number of n-grams.
        """
        keys, row, has = ngrams(texts, self.n)
        false = self.false_rate if fill is None else fill
        total = np.bincount(row, minlength=len(texts)).astype(float)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        masks = self.lookup(keys)
        hits = np.stack([np.bincount(row, weights=((masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(float), minlength=len(texts)) for j in range(len(self.languages))], axis=1)
        share = (hits / np.maximum(total, 1)[:, None] - false) / (1 - false)
        share = np.clip(share, 0.0, 1.0)
        log = total[:, None] * share * 3.0
        log -= log.max(axis=1, keepdims=True)
        odds = np.exp(np.maximum(log, -60))
        odds /= odds.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        score = odds[np.arange(len(texts)), best] * share[np.arange(len(texts)), best]
        names = [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has)]
        return names, np.where(has, np.clip(score, 0, 1), 0.0)


def build_filters(texts: dict[str, Sequence[str]], bits: int = 1 << 18, hashes: int = 3, n: int = 3, floor: float = 0.06, least: int = 2) -> LanguageModel:
    """Put into a language's filter the n-grams that it has at least ``least`` times and at a rate of at least ``floor`` times the highest rate among the languages."""
    languages = sorted(texts)
    model = LanguageModel(languages, np.zeros((bits, max(1, -(-len(languages) // 64))), np.uint64), hashes, n)
    counts = []
    for name in languages:
        keys, _, _ = ngrams(texts[name], n)
        value, count = np.unique(keys, return_counts=True)
        counts.append((value, count, count / max(1, count.sum())))
    every = np.unique(np.concatenate([c[0] for c in counts])) if counts else np.zeros(0, np.uint64)
    top = np.zeros(len(every))
    for value, _, rate in counts:
        at = np.searchsorted(every, value)
        top[at] = np.maximum(top[at], rate)
    for j, (value, count, rate) in enumerate(counts):
        enough = min(least, int(count.max(initial=1)))
        inside = value[(count >= enough) & (rate >= floor * top[np.searchsorted(every, value)])]
        for at in model.positions(inside):
            np.bitwise_or.at(model.slices[:, j // 64], at, np.uint64(1) << np.uint64(j % 64))
    return model


def fit_languages(docs: DataFrame, rows: int = 250, longest: int = 20_000, **options) -> LanguageModel:
    """Fit on a bounded sample: for each non-null lang at most ``rows`` texts of at most ``longest`` characters.

    Only rows whose crc32(doc_id) mod 4 is not 2 are used, chosen by a hash of the id. The sample
    grows with the number of languages only. An empty table gives a model without languages.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.length("text").between(1, longest) & (remainder(F.col("doc_id"), 4) != 2))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id"))
    chosen = usable.select("lang", "doc_id", sample_key(F.coalesce(F.col("doc_id"), F.lit(-1)), "language").alias("turn")).withColumn("place", place).where(F.col("place") <= rows)
    names = chosen.where("doc_id is not null").select("doc_id", F.col("lang").alias("as_lang")).distinct()
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(names), "doc_id").where("lang = as_lang").select("lang", "text").distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return build_filters(texts, **options)


def identify_languages(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, then the columns in ``keep``, for each row of ``docs``.

    Edge cases: a null text, and one without a letter, is ``und`` with score 0; equal estimates go to the first
    language in code point order; repeated rows are kept; an empty table gives no rows; columns that
    are not in ``keep`` are ignored, and kept ones named as a result column are dropped.
    """
    short_batches(docs.sparkSession)
    kept = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "held_out", "lang_pred", "score", "text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of bits and 64 languages a word
    with_text = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fill = shared.value, shared.value.false_rate if shared.value.languages else None
        for batch in pieces(batches, 1 << 20):
            names, score = own.decide([t or "" for t in batch.column("text").to_pylist()], fill)
            extra = [*kept, *["text"] * with_text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64()), *[batch.column(c) for c in extra]],
                names=["doc_id", "held_out", "lang_pred", "score", *extra],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), *kept, "text")
    types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in [*kept, *["text"] * with_text])
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double{types}")
