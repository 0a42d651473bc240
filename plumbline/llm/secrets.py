"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, short_batches

KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    """A pattern for an ASCII word in either case, and nothing beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = ("password", "passwd", "secret", "token")
_KEY = re.compile("(?:" + "|".join([*map(_either, _NAMES), _either("api") + "_?" + _either("key")]) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
#: Characters of stretches that may be encoded random bytes. Every stretch is tested, whatever its length and kinds.
_SIGNS = "+/_=-"
_HINTS = (*_NAMES, "apikey", "api_key")

#: Rates of a-z in ordinary prose, in per mille.
_PROSE = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost without overlap for each kind."""
    out = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _KEY.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


#: Classes of ASCII characters: lower case, capitals, digits, signs; 9 for all others.
_CLASS = np.full(128, 9, np.int64)
#: Alphabets of a random key: size and prior; keys are mostly hex, base62 or base64.
_SIZES = {"decimal": 10, "hex": 16, "letters": 26, "base32": 32, "base36": 36, "both": 52, "base62": 62, "base64": 64}
_PRIOR = {10: 0.02, 16: 0.2, 26: 0.06, 32: 0.06, 36: 0.08, 52: 0.1, 62: 0.25, 64: 0.23}
#: Ordinary text as chains of classes, one for each kind of it: how often a stretch begins with a class, and how often one follows another.
#: Prose and numbers; names as programs have them (camelCase, versions); paths, addresses and names with signs.
_CHAINS = [
    ([0.7, 0.15, 0.1, 0.05], [[0.9, 0.03, 0.02, 0.05], [0.17, 0.75, 0.04, 0.04], [0.05, 0.05, 0.75, 0.15], [0.4, 0.2, 0.3, 0.1]]),
    ([0.55, 0.4, 0.04, 0.01], [[0.83, 0.12, 0.04, 0.01], [0.88, 0.09, 0.02, 0.01], [0.06, 0.33, 0.6, 0.01], [0.6, 0.3, 0.08, 0.02]]),
    ([0.6, 0.1, 0.1, 0.2], [[0.72, 0.03, 0.07, 0.18], [0.3, 0.45, 0.07, 0.18], [0.1, 0.05, 0.6, 0.25], [0.55, 0.12, 0.18, 0.15]]),
]
_BEGIN, _NEXT = np.log([c[0] for c in _CHAINS]), np.log([c[1] for c in _CHAINS])
#: How often a letter of ordinary prose is a vowel (aeiou) at the start of a run of letters, after a vowel, after a consonant.
_VOWEL = (0.4, 0.3, 0.5)
#: Log rate of a character within its class, or of a letter within vowels or consonants; digits and signs evenly.
_WITHIN = np.zeros(128)
#: 1 for vowels, 0 for consonants, -1 for all others.
_KIND = np.full(128, -1, np.int64)
#: Membership in the alphabets narrower than their classes: hex in either case, base32.
_HEXES, _BASE32 = np.zeros((2, 128), bool), np.zeros(128, bool)
for _c in range(128):
    _x = chr(_c)
    if _x in _SIGNS or _x.isalnum():
        _CLASS[_c] = 0 if _x.islower() else 1 if _x.isupper() else 2 if _x.isdigit() else 3
        if _x.isalpha():
            _KIND[_c] = _x.lower() in "aeiou"
            _WITHIN[_c] = math.log(_PROSE[_x.lower()] / sum(v for k, v in _PROSE.items() if (k in "aeiou") == bool(_KIND[_c])))
        else:
            _WITHIN[_c] = math.log(0.1 if _x.isdigit() else 0.2)
    _HEXES[0, _c], _HEXES[1, _c], _BASE32[_c] = _x in "0123456789abcdef", _x in "0123456789ABCDEF", _x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def encoding(value: str) -> tuple[str, int]:
    """The narrowest alphabet that holds the string (name, size)."""
    kinds = {"d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value}
    if "s" in kinds:
        return "base64", 64
    if kinds == {"d"}:
        return "decimal", 10
    if "d" in kinds and (not set(value) - set("0123456789abcdef") or not set(value) - set("0123456789ABCDEF")):
        return "hex", 16
    if len(kinds) == 1:
        return "letters", 26
    if not set(value) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        return "base32", 32
    return ("both", 52) if "d" not in kinds else ("base36", 36) if len(kinds) == 2 else ("base62", 62)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(value: str, size: int) -> tuple[float, float, float]:
    """p-values, under uniform random symbols, of too uneven counts, too few runs of classes, and serial correlation."""
    n = len(value)
    counts = Counter(value)
    chi = sum(c * c for c in counts.values()) * size / n - n
    spread = math.sqrt(2 * (size - 1) * max(1 - 1 / n, 1e-9))
    uneven = _tail((chi - (size - 1)) / spread)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in value]
    same = sum((classes.count(k) / n) ** 2 for k in set(classes))
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    expected, room = (n - 1) * (1 - same), math.sqrt(max((n - 1) * same * (1 - same), 1e-9))
    runs = _tail((expected - changes) / room)
    x = np.array([ord(c) for c in value], float)
    x = x - x.mean()
    total = float(x @ x)
    serial = 1.0 if total == 0 else 2 * _tail(abs(float(x[1:] @ x[:-1]) / total + 1 / n) * math.sqrt(n))
    return uneven, runs, serial


#: Identifiers by their form, which are random by design and no secrets.
_UUID = re.compile("[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: What names are put together from; in a long name these are longer than chance makes them.
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def named(value: str) -> bool:
    """Whether a stretch is an identifier by its form: a UUID, or 24 letters and digits or more, in both cases, in words of 2.5 characters on average (3.5 without digits)."""
    if _UUID.fullmatch(value):
        return True
    return len(value) >= 24 and value.isalnum() and value.lower() != value != value.upper() and len(value) >= (3.5 if value.isalpha() else 2.5) * len(_WORD.findall(value))


def stretches(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every stretch of a text, trailing ``=`` left out, and a p-value against the hypothesis of ordinary text.

    Each of the battery's three tests has a likelihood ratio of its own, random symbols against ordinary text: uniformity (letters at even
    rather than at prose rates), runs (of classes of characters, against a chain) and serial correlation (of vowels and
    consonants, against a chain). Factors that condition on each other in turn multiply to one likelihood ratio of the whole
    stretch, whose chance of passing t under ordinary text is 1/t at most, at any length (Markov's
    inequality): its inverse is the combined p-value. The ordinary text may be of any of the kinds in ``_CHAINS``: the least favourable counts.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, codes, 0).astype(np.int64)
    kind = _CLASS[codes]
    inside = np.r_[False, kind < 9, False]
    start, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if len(start):
        padding = np.r_[0, np.cumsum(codes != ord("="))]
        body = np.maximum(np.searchsorted(padding, padding[end], "left"), start)  # just past the last other character
        start, end = start[body > start], body[body > start]
    if not len(start):
        return start, end, np.zeros(0)
    summed = lambda x: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(x)]))
    both = np.r_[False, (kind[:-1] < 9) & (kind[1:] < 9)]
    both[start] = False
    vowel = _KIND[codes]
    after = np.where(both, np.r_[-1, vowel[:-1]], -1)  # what kind of letter is just before, in the same stretch
    rate = np.where(after == 1, _VOWEL[1], np.where(after == 0, _VOWEL[2], _VOWEL[0]))
    serial = np.where(vowel < 0, 0.0, np.log(np.where(vowel == 1, rate, 1 - rate)))
    before = np.r_[0, kind[:-1]]
    runs = np.full(len(start), -np.inf)
    for begin, follow in zip(_BEGIN, _NEXT):
        step = np.zeros(len(codes))
        step[both] = follow[before[both], kind[both]]
        step[start] = begin[kind[start]]
        runs = np.maximum(runs, summed(step))
    n, ordinary = end - start, runs + summed(serial) + summed(_WITHIN[codes])
    lower, upper, digit, sign = (summed(kind == k) > 0 for k in range(4))
    hexes = (summed(_HEXES[0][codes]) == n) | (summed(_HEXES[1][codes]) == n)
    size = np.select(
        [sign, digit & ~lower & ~upper, digit & hexes, ~digit & (lower ^ upper), ~lower & (summed(_BASE32[codes]) == n), ~digit, lower ^ upper],
        [64, 10, 16, 26, 32, 52, 36], 62,
    )
    prior = np.zeros(65)
    prior[list(_PRIOR)] = np.log(list(_PRIOR.values()))
    log = -n * np.log(size) + prior[size] - ordinary
    return start, end, np.exp(-np.maximum(log, 0.0))


def random_spans(text: str, level: float = 1e-3, false_rate: float = 0.02) -> list[tuple[int, int, str]]:
    """Stretches that pass as random: the combined p-value refuses ordinary text, and the battery does not refuse randomness.

    All stretches of a document are tested at once by the step-up procedure with weights (a stretch's share of the false
    discovery rate is its share of the length), so the rate is controlled in each document by itself: a
    document's result depends on no other's. In the other direction, the three tests' p-values under uniform symbols
    (``battery``, of the inferred encoding) must not refuse at ``level``; copies of a stretch have one rank. Identifiers by their form (``named``) are left alone.
    """
    start, end, p = stretches(text)
    weighted = p * np.sum(end - start) / ((end - start) * len(start))
    found: dict[str, list[int]] = {}
    for k in np.flatnonzero(weighted <= false_rate):
        found.setdefault(text[start[k] : end[k]], []).append(k)
    passed = []
    for value, places in found.items():
        if not named(value) and min(1.0, 3 * min(battery(value, encoding(value)[1]))) >= level:
            passed.append((float(weighted[places[0]]), places))
    passed.sort()
    last = max((k for k, (q, _) in enumerate(passed, 1) if q <= false_rate * k / len(start)), default=0)
    out = []
    for s, e in sorted((int(start[k]), int(end[k])) for _, places in passed[:last] for k in places):
        while text[e : e + 1] == "=":
            e += 1
        out.append((s, e, "random"))
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind: the fixed ones, and random stretches that none of them covers."""
    if not text:
        return []
    base = base_spans(text)
    more = [r for r in random_spans(text) if not any(s <= r[0] and r[1] <= e for s, e, _ in base)]
    return sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with each stretch of spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, keep: Sequence[str] = (), replace: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, then ``keep``, for each row.

    With ``replace`` a kept text has its spans redacted. Spans are ``kind:start:end`` in code points, end exclusive.
    Edge cases: a null text is scanned as empty (and stays null if kept); repeated rows are kept; an empty
    table gives no rows; columns not in ``keep`` are ignored, kept ones named as a result column dropped.
    """
    short_batches(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    kept = [c for c in dict.fromkeys(keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            found = [scan(t) for t in texts]
            counts = [Counter(k for _, _, k in f) for f in found]
            written = [[f"{k}:{s}:{e}" for s, e, k in f] for f in found]
            digest = [hashlib.sha256(",".join(x for x in w if x[:2] != "ra").encode()).hexdigest() for w in written]
            clean = pa.array([redact(t, f) if t and f else t for t, f in zip(texts, found)], pa.string()) if replace else None
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]], pa.array(digest, pa.string()), pa.array([",".join(w) for w in written], pa.string()), pa.array([c["random"] for c in counts], pa.int64())]
                + [clean if c == "text" and replace else batch.column(c) for c in kept],
                names=[*names, *kept],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in kept if c != "text"])
    types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long{types}")
