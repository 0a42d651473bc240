"""Exact merge-type (BPE) encoding and decoding for sentencepiece vocabularies, by backtracking."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, short_batches

_BLANK = "▁"
#: A vocabulary has blanks inside no piece but those of blanks alone, so no merge crosses a unit's border.
_UNIT = re.compile(" *[^ \n]+| +|\n")


class Automaton:
    """Aho-Corasick automaton over reversed pieces: run from the end of a text, the state at a position knows all
    pieces that start there, the longest first. Failure moves are kept once found."""

    def __init__(self, words: dict[str, int]):
        self.moves: list[dict[str, int]] = [{}]
        self.found: list[tuple[tuple[int, int], ...]] = [()]
        for word, value in words.items():
            state = 0
            for c in reversed(word):
                after = self.moves[state].get(c)
                if after is None:
                    after = self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    self.found.append(())
                state = after
            self.found[state] = ((len(word), value),)
        self.fail = [0] * len(self.moves)
        queue = deque(self.moves[0].values())
        trie = [list(m.items()) for m in self.moves]
        while queue:  # breadth first: a state's failure state is shallower, and ready
            state = queue.popleft()
            self.found[state] += self.found[self.fail[state]]
            for c, after in trie[state]:
                self.fail[after] = self.follow(self.fail[state], c)
                queue.append(after)

    def follow(self, state: int, c: str) -> int:
        """The move by a character, through failure states; remembered."""
        at = state
        while (after := self.moves[at].get(c)) is None and at:
            at = self.fail[at]
        after = after or 0
        if at != state:
            self.moves[state][c] = after
        return after

    def starts(self, text: str) -> list[tuple[tuple[int, int], ...]]:
        """For each position, (length, id) of the pieces that start there, the longest first."""
        state, out, moves, found = 0, [], self.moves, self.found
        for c in reversed(text):
            after = moves[state].get(c)
            state = self.follow(state, c) if after is None else after
            out.append(found[state])
        out.reverse()
        return out


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, read with the library; encoding and decoding are ours."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        scores = {p: model.get_score(i) for p, i in self.ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: The best score has rank 0; merging takes ranks in order.
        self.rank = {p: place[s] for p, s in scores.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = model.unk_id()
        self.crossing = [p for p in self.ids if _BLANK in p[1:] and p.strip(_BLANK)]
        reachable = {}
        for piece, i in self.ids.items():
            parts, last = self._merge(piece)
            if parts == [piece]:  # a piece that merging never makes can't be in an encoding
                if last:
                    self.halves[piece] = last
                reachable[piece] = i
        self.automaton = Automaton(reachable)
        self.fits: dict[int, bool] = {}
        self.named = list(map(str, range(size)))
        self.plain = [p.replace(_BLANK, " ") for p in self.pieces]
        self.foreign = re.compile("[^ " + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]+")

    def merge(self, text: str) -> list[str]:
        """Merging by the book: the best scored pair first, the leftmost of equals."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merged parts, and the two parts of the last merge."""
        parts, last = list(text), None
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [last[0] + last[1]]
        return parts, last

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: merging their joined text again gives just the two.

        Only merges over the border can spoil that, so the border is merged again backwards in time: of the two
        parts at the border the one made later is taken apart, and each pair that stood there before
        must not have had a better score than the merge undone (at equal scores the left one comes first).
        """
        key = left * len(self.pieces) + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._border(self.pieces[left], self.pieces[right])
        return known

    def _border(self, a: str, b: str) -> bool:
        rank, halves = self.rank, self.halves
        until = float("inf")  # the border pair must not have merged before this moment
        while True:
            across = rank.get(a + b)
            if across is not None and across < until:
                return False
            parts_a, parts_b = halves.get(a), halves.get(b)
            if parts_a is None and parts_b is None:
                return True
            if parts_b is None or (parts_a is not None and rank[a] > rank[b]):
                until, a = rank[a], parts_a[1]
            else:
                until, b = rank[b] + 0.5, parts_b[0]

    def _known(self, unit: str) -> list[int]:
        """Encode characters of the vocabulary: longest match first, backtracking over a bitfield of failed positions."""
        n = len(unit)
        starts = self.automaton.starts(unit)
        failed, at, left = 0, 0, -1
        tokens: list[int] = []
        tried = [0]  # by depth, the next option at its position
        where = [0]
        size, fits = len(self.pieces), self.fits
        while at < n:
            options = starts[at]
            for k in range(tried[-1], len(options)):
                length, i = options[k]
                if failed >> (at + length) & 1:
                    continue
                if left >= 0:
                    fit = fits.get(left * size + i)
                    if not (self.compatible(left, i) if fit is None else fit):
                        continue
                tried[-1] = k + 1
                tokens.append(i)
                left = i
                at += length
                tried.append(0)
                where.append(at)
                break
            else:
                failed |= 1 << at
                tried.pop()
                where.pop()
                if not tokens:
                    raise ValueError(f"no encoding of {unit!r}")
                tokens.pop()
                left = tokens[-1] if tokens else -1
                at = where[-1]
        return tokens

    def unit(self, unit: str) -> list[int]:
        """Ids of a unit; a character outside the vocabulary is its UTF-8 bytes and takes part in no merge."""
        if not self.foreign.search(unit):
            return self._known(unit)
        out: list[int] = []
        at = 0
        for m in self.foreign.finditer(unit):
            if m.start() > at:
                out += self._known(unit[at : m.start()])
            at = m.end()
            for c in m.group():
                out += [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]
        return out + (self._known(unit[at:]) if at < len(unit) else [])

    def written(self, unit: str) -> tuple[int, str, str]:
        """Of a unit with plain blanks: the number of ids, the ids in text, and their decoded text."""
        ids = self.unit(unit.replace(" ", _BLANK))
        if self.foreign.search(unit) and unit != " ":
            return len(ids), ",".join(map(str, ids)), self.decode([self.ids[_BLANK], *ids])
        return len(ids), ",".join([self.named[i] for i in ids]), "".join([self.plain[i] for i in ids])

    def encode(self, text: str | None) -> list[int]:
        return [i for u in units(text) for i in self.unit(u.replace(" ", _BLANK))]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8 with replacements, the first blank dropped."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_replaced(bytes(raw)))
                raw.clear()
            out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(_BLANK, " "))
        if raw:
            out.append(_replaced(bytes(raw)))
        text = "".join(out)
        return text[1:] if text[:1] == " " and ids[0] not in self.byte_of else text


def _replaced(raw: bytes) -> str:
    """UTF-8, each byte that begins no character replaced on its own."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def units(text: str | None) -> list[str]:
    """Stretches between which no merge happens; joined, they are the text with a blank in front."""
    if not text:
        return []
    return _UNIT.findall(" " + (text.replace(_BLANK, " ") if _BLANK in text else text))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once a process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
        if _LOADED[path].crossing:
            raise ValueError("pieces cross blanks; units by blanks would not be exact")
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, keep: Sequence[str] = (), with_ids: bool = False, cached: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, then ``ids`` if asked for and ``keep``, for each row.

    ``path`` is the model file, at the same place on every executor. Units (mostly words) are encoded once
    and kept in a table of at most ``cached`` entries, emptied when full, so memory is bounded.
    Edge cases: a null text is encoded as empty: no ids; repeated rows are kept; an empty table gives no
    rows; columns not in ``keep`` are ignored, kept ones named as a result column dropped.
    """
    short_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *["ids"] * with_ids]
    kept = [c for c in dict.fromkeys(keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        cache: dict[str, tuple[int, str, str]] = {}

        def look(unit: str) -> tuple[int, str, str]:
            got = vocab.written(unit)
            if len(unit) <= 100:
                if len(cache) >= cached:
                    cache.clear()
                cache[unit] = got
            return got

        get = cache.get
        for batch in pieces(batches):
            counts, digests, decoded, sizes, lists = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = [get(u) or look(u) for u in units(text)]
                ids = ",".join([f[1] for f in found])
                back = "".join([f[2] for f in found])
                back = (back[1:] if back[:1] == " " else back).encode()
                counts.append(sum([f[0] for f in found]))
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                sizes.append(len(back))
                if with_ids:
                    lists.append([int(i) for i in ids.split(",")] if ids else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(sizes, pa.int64())]
                + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])
                + [batch.column(c) for c in kept],
                names=[*names, *kept],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in kept if c != "text"])
    types = ", ids array<int>" * with_ids + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long{types}")
