"""Language-model scoring: a hierarchical Pitman-Yor model over real words, seated by Gibbs sampling.

Every word that precedes another is a context with a restaurant of its own; their tables are the customers of one
parent restaurant, whose base is uniform over the known words and one unknown. The number of restaurants grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, divided, mix64, pieces, remainder, short_batches, stored, text_bytes, words
from .pitman_yor import Seating, discount_of, spread

#: The token after the last word of a text, and the context of its first one.
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A2757A2757A275)
#: Frequent words have two-byte codes on the way between tasks; this code means that a whole hash follows. Only the layout depends on it.
_RARE = 65_535
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text, and rows, that make one block.
BLOCK, BLOCK_ROWS = 8 << 20, 60_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (64 bits) of the texts with an end after each text, the word before each, and offsets by text."""
    data, offsets = text_bytes(column)
    hashes, _, _, first = words(data, offsets)
    rows = len(offsets) - 1
    places = first + np.arange(rows + 1)
    word = np.full(len(hashes) + rows, END, np.uint64)
    owner = np.repeat(np.arange(rows), np.diff(first))
    word[np.arange(len(hashes)) + owner] = hashes
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[places[:-1]] = START
    return word, context, places


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes: where each distinct one is first, in an order by value, and the place of every key among these.

    Sorting values with their index in the low bits is several times faster than an argsort; should two keys
    differ in these bits alone, a full sort takes over.
    """
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << max(len(keys) - 1, 1).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if (new[1:] & (((ordered[1:] ^ ordered[:-1]) & ~low) == 0)).any():
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * _ODD + mix64(word))


def _press(*arrays: np.ndarray) -> bytes:
    parts = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays), *map(len, parts)], np.int64).tobytes() + b"".join(parts))


def _unpress(data: bytes, kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]) + 1)[1:]
    at, out = 8 * (len(sizes) + 1), []
    for size, kind in zip(sizes, kinds.split()):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _coded(values: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(frequent):
        return np.full(len(values), _RARE, np.uint16), values
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    rare = frequent[at] != values
    return np.where(rare, _RARE, at).astype(np.uint16), values[rare]


def _decoded(code: np.ndarray, rare: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    out = np.empty(len(code), np.uint64)
    away = code == _RARE
    out[away] = rare
    if len(frequent):
        out[~away] = frequent[code[~away]]
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Tokens, contexts, sizes of texts, ids and held_out marks of about ``BLOCK`` bytes of text, at least one whole row.

    Texts are taken apart in small pieces, whose arrays fit a processor's cache.
    """
    held, size, rows = [], 0, 0
    for batch in pieces(batches, 1 << 18):
        word, context, places = tokens(batch.column("text"))
        ids = batch.column("doc_id")
        held.append((word, context, np.diff(places), ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)))
        size += batch.column("text").nbytes
        rows += batch.num_rows
        if size >= BLOCK or rows >= BLOCK_ROWS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size, rows = [], 0, 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


class Part:
    """The distinct pairs (context, word) of one part, their training counts, and what each block asked for."""

    def __init__(self, table: pa.Table, layout: Layout):
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        self.asked: list[tuple[int, int, int]] = []  # block, first and last of its pairs
        context, word, count = [], [], []
        at = 0
        self.runs = []
        for k in order.tolist():
            c_code, c_rare, run, w_code, w_rare, n = _unpress(table.column("payload")[k].as_py(), "u2 u8 u4 u2 u8 u4")
            context.append(np.repeat(_decoded(c_code, c_rare, layout.frequent), run))
            word.append(_decoded(w_code, w_rare, layout.frequent))
            count.append(n)
            self.runs.append(run)
            self.asked.append((table.column("block")[k].as_py(), at, at + len(n)))
            at += len(n)
        context, word, count = np.concatenate(context), np.concatenate(word), np.concatenate(count)
        first, self.place = distinct(pair_key(context, word))
        self.count = np.bincount(self.place, count, len(first)).astype(np.int64)
        context, word = context[first], word[first]
        first, self.context = distinct(context)
        self.contexts = context[first]
        mixed = mix64(word)  # its first bits are the bucket, so that dishes are in the order in which their buckets answer
        first, self.dish = distinct(mixed)
        self.dishes, self.bucket = word[first], layout.bucket_of(mixed[first])
        self.total = np.bincount(self.context, self.count, len(self.contexts)).astype(np.int64)
        self.shared = np.isin(self.contexts, layout.hot)  # contexts that are dealt over several parts
        if self.shared.any():
            self.total[self.shared] = layout.hot_total[np.searchsorted(layout.hot, self.contexts[self.shared])]
        self.tables = np.minimum(self.count, 1)


class Layout:
    """What every task knows: frequent words, contexts that are dealt over several parts, and how many parts there are."""

    def __init__(self, frequent: np.ndarray, hot: np.ndarray, hot_seen: np.ndarray, hot_total: np.ndarray, parts: int, buckets: int, per_part: int):
        order = np.argsort(hot)
        self.frequent, self.parts, self.buckets = np.sort(frequent), parts, buckets
        self.hot, self.hot_total = hot[order], hot_total[order]
        self.shift = np.uint64(64 - (buckets - 1).bit_length())  # buckets are a power of two
        self.ways = -(-hot_seen[order] * 4 // per_part).astype(np.uint64)

    def bucket_of(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> self.shift).astype(np.int64)

    def part_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = context.copy()
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = self.hot[at] == context
            key[hot] += _ODD * (mix64(word[hot]) % self.ways[at[hot]])
        return (mix64(key) % np.uint64(self.parts)).astype(np.int64)


class Levels:
    """Discounts and strength of both levels, the parent's totals, and open tables of the contexts dealt over parts."""

    def __init__(self, strength: float, discount: float, discount0: float, hot_tables: dict[int, int]):
        self.strength, self.discount, self.discount0 = strength, discount, discount0
        self.hot_tables = hot_tables
        self.hot_g: dict[int, float] = {}
        self.floor = 0.0  # the parent's probability of a word that no context has served

    def draw_hot(self, seed: int) -> None:
        rng = np.random.default_rng([seed, 31])
        self.hot_g = {h: float(spread(rng, np.array([t]), self.strength, self.discount)[0]) for h, t in sorted(self.hot_tables.items())}


def sweep(part: Part, chance: np.ndarray, seating: Seating, levels: Levels, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs sweep over the restaurants of a part, given the parent's ``chance`` of each dish; open tables of each context."""
    g = spread(rng, _opened(part, levels), levels.strength, levels.discount)
    if part.shared.any():
        g[part.shared] = [levels.hot_g[int(h)] for h in part.contexts[part.shared]]
    many = np.flatnonzero(part.count > 1)
    weight = levels.discount * g[part.context[many]] * chance[part.dish[many]]
    part.tables[many] = seating.draw(rng, part.count[many], weight, part.tables[many])
    return _opened(part, levels)


def _opened(part: Part, levels: Levels) -> np.ndarray:
    opened = np.bincount(part.context, part.tables, len(part.contexts))
    if part.shared.any():
        opened[part.shared] = [levels.hot_tables[int(h)] for h in part.contexts[part.shared]]
    return opened


def predictive(part: Part, chance: np.ndarray, levels: Levels, seed: int, sweeps: int, burn: int) -> np.ndarray:
    """Probability of each pair of a part, averaged over the sweeps after ``burn``."""
    rng, seating = np.random.default_rng([seed, 20]), Seating(levels.discount)
    many = np.flatnonzero(part.count > 1)
    part.tables[many] = seating.first(part.count[many], levels.discount * _opened(part, levels)[part.context[many]] * chance[part.dish[many]])
    total = np.zeros(len(part.count))
    for k in range(sweeps):
        opened = sweep(part, chance, seating, levels, rng)
        if k >= burn:
            own = part.count - levels.discount * part.tables
            total += (own + (levels.strength + levels.discount * opened[part.context]) * chance[part.dish]) / (levels.strength + part.total[part.context])
    return total / max(sweeps - burn, 1)


def _up(part: Part, number: int, layout: Layout) -> pa.Table:
    """Tables of each dish, one row for each bucket of dishes; and one row (bucket -1) with the hot contexts' tables and how many counts are 1 and 2."""
    sent = np.bincount(part.dish, part.tables, len(part.dishes)).astype(np.int64)
    border = np.searchsorted(part.bucket, np.arange(layout.buckets + 1))
    full = [b for b in range(layout.buckets) if border[b] < border[b + 1]]
    hot = np.flatnonzero(part.shared)
    of_hot = np.bincount(part.context, part.tables, len(part.contexts)).astype(np.int64)[hot]
    return pa.table({
        "bucket": pa.array([-1, *full], pa.int64()), "part": pa.array([number] * (len(full) + 1), pa.int64()),
        "dishes": pa.array([part.contexts[hot].tobytes(), *[part.dishes[border[b] : border[b + 1]].tobytes() for b in full]], pa.binary()),
        "tables": pa.array([of_hot.tobytes(), *[_press(sent[border[b] : border[b + 1]].astype(np.uint32)) for b in full]], pa.binary()),
        "sent": pa.array([0, *[int(sent[border[b] : border[b + 1]].sum()) for b in full]], pa.int64()),
        "once": pa.array([int((part.count == 1).sum()), *[0] * len(full)], pa.int64()), "twice": pa.array([int((part.count == 2).sum()), *[0] * len(full)], pa.int64()),
    })


_UP = "bucket long, part long, dishes binary, tables binary, sent long, once long, twice long"


def score_language(
    docs: DataFrame, tokens_per_part: int = 2_000_000, strength: float = 5.0, rounds: int = 2, sweeps: int = 4, burn: int = 1, seed: int = 7
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Steps, each linear in the input. (1) Words are counted. (2) Texts become blocks; a block asks each part for its
    distinct pairs of a word and the word before, with training counts: contexts are dealt to parts by hash, contexts with more
    than a quarter of ``tokens_per_part`` tokens over several parts by the word that follows, and a repeated pair is sent
    once a block, so neither a frequent word nor a frequent pair makes a part hot. (3) Each of ``rounds`` times the parts send
    the tables of each word up, buckets of words seat them in the parent restaurant and send its probabilities back.
    The first round has one table for each pair; later ones sample the context restaurants by Gibbs sweeps. (4) Parts
    sample ``sweeps`` times more, average the predictive probabilities of all but ``burn``, and answer the blocks, which sum by text.

    Every customer's seat is drawn from its exact conditional given the parent's probabilities (``pitman_yor``); those are
    held fixed while the restaurants below are sampled, so both levels alternate, and a context that is dealt over
    parts has its number of open tables from the round before. Word counts, and so n_known and base_score, are exact
    but for equal 64-bit hashes of different words.

    Training rows are those whose crc32(doc_id) mod 7 is not 2. Edge cases: a null or empty text is the end
    token alone; rows that repeat an id are scored one by one; a null id trains; an empty table gives no rows;
    without training rows the vocabulary is empty and each token has the unknown's probability; further columns are ignored.
    A text is worked on as a whole, so the longest one bounds a task's memory from below.
    """
    spark = docs.sparkSession
    short_batches(spark, 2048)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, _, sizes, _, _, held in blocks(batches):
            first, place = distinct(word)
            every = np.bincount(place, minlength=len(first))
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(every), pa.array(np.bincount(place[~np.repeat(held, sizes)], minlength=len(first)))], names=["word", "every", "train"])

    counted = rows.mapInArrow(count, "word long, every long, train long")
    counted = stored(counted.groupBy("word").agg(F.sum("every").alias("every"), F.sum("train").alias("train")), "language-words")
    sums = counted.agg(
        F.coalesce(F.sum("every"), F.lit(0)).alias("every"), F.coalesce(F.sum("train"), F.lit(0)).alias("train"), F.count(F.when(F.col("train") > 0, 1)).alias("vocabulary"),
        F.count(F.when(F.col("train") == 1, 1)).alias("once"), F.count(F.when(F.col("train") == 2, 1)).alias("twice"),
    ).first()
    every, train_tokens, vocabulary = sums["every"], sums["train"], sums["vocabulary"]
    # the most frequent words, as many as there are codes at most: whole classes of counts, an eighth of an octave each
    octave = F.floor(F.log2("every") * 8).cast("int")
    classes = sorted(((r["octave"], r["count"]) for r in counted.groupBy(octave.alias("octave")).count().collect()), reverse=True)
    room = np.cumsum([n for _, n in classes]) <= _RARE
    top = counted.where(octave >= classes[room.sum() - 1][0]).collect() if len(classes) and room[0] else []
    signed = lambda values: np.array(values, np.int64).view(np.uint64)
    parts, buckets = max(8, -(-every // tokens_per_part)), max(8, 1 << (every // (6 * tokens_per_part)).bit_length())
    ends = [(r["every"], r["train"]) for r in top if r["word"] == int(END.view(np.int64))]
    if not ends:
        ends = [(r["every"], r["train"]) for r in counted.where(F.col("word") == int(END.view(np.int64))).collect()]
    n_ends, train_ends = ends[0] if ends else (0, 0)
    seen = [(int(signed([r["word"]])[0]), r["every"], r["train"]) for r in top if r["word"] != int(END.view(np.int64))] + [(int(START), n_ends, train_ends)]
    hot = [x for x in seen if 4 * x[1] > tokens_per_part]
    discard(counted)
    layout = Layout(signed([r["word"] for r in top]), np.array([x[0] for x in hot], np.uint64), np.array([x[1] for x in hot], np.int64), np.array([x[2] for x in hot], np.int64), parts, buckets, tokens_per_part)
    shared = spark.sparkContext.broadcast(layout)  # at most 65,535 words and numbers

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        task = TaskContext.get().partitionId()
        for serial, (word, context, sizes, ids, absent, held) in enumerate(blocks(batches)):
            block = (task << 24) | serial
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first, place = distinct(pair_key(context, word))
            w, c = word[first], context[first]
            n = np.bincount(place[~held[owner]], minlength=len(first)).astype(np.uint32)
            part = layout.part_of(c, w)
            # by part, then by as many bits of the context as there is room for: equal contexts mostly make one run
            index, parts_bits = max(len(first) - 1, 1).bit_length(), max(layout.parts - 1, 1).bit_length()
            order = np.sort((part.astype(np.uint64) << np.uint64(64 - parts_bits)) | (c >> np.uint64(parts_bits + index) << np.uint64(index)) | np.arange(len(first), dtype=np.uint64))
            order = (order & np.uint64((1 << index) - 1)).astype(np.int64)
            w, c, n, part = w[order], c[order], n[order], part[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
            low = np.uint64((1 << max(len(place) - 1, 1).bit_length()) - 1)
            by_pair = (np.sort((place.astype(np.uint64) * (low + np.uint64(1))) | np.arange(len(place), dtype=np.uint64)) & low).astype(np.int64)
            times = np.bincount(place, minlength=len(order)).astype(np.uint32)
            border = np.searchsorted(part, np.arange(layout.parts + 1))
            full = np.flatnonzero(np.diff(border))
            out = []
            for p in full:
                lo, hi = border[p], border[p + 1]
                starts = np.flatnonzero(np.r_[True, c[lo + 1 : hi] != c[lo : hi - 1]])
                out.append(_press(*_coded(c[lo:hi][starts], layout.frequent), np.diff(np.r_[starts, hi - lo]).astype(np.uint32), *_coded(w[lo:hi], layout.frequent), n[lo:hi]))
            own = _press(ids.astype(np.int64), absent.astype(np.uint8), held.astype(np.uint8), sizes.astype(np.int64), times, owner[by_pair].astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *full.tolist()], pa.int64()), pa.array([block] * (len(full) + 1), pa.int64()), pa.array([own, *[None] * len(full)], pa.binary()), pa.array([None, *out], pa.binary())],
                names=["part", "block", "own", "payload"],
            )

    packed = rows.mapInArrow(pack, "part long, block long, own binary, payload binary")
    asked_rows, own_rows = divided(packed, F.col("part") >= 0, "language-blocks")
    asked = asked_rows.select("part", "block", "payload")
    base = 1.0 / (vocabulary + 1)
    levels = Levels(strength, 0.5, discount_of(sums["once"], sums["twice"]), {int(h): 1 for h in layout.hot})
    parent_tables = vocabulary
    answers = None

    def chances(part: Part, table: pa.Table, levels: Levels) -> np.ndarray:
        got = {r["bucket"]: np.frombuffer(r["chance"], np.float32) for r in table.select(["bucket", "chance"]).to_pylist()}
        return np.concatenate([got[b] for b in sorted(got)]).astype(np.float64) + levels.floor

    def open_all(table: pa.Table) -> pa.Table:
        return _up(Part(table, shared.value), table.column("part")[0].as_py(), shared.value)

    def sampler(levels: Levels, round_: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            part, number = Part(left, shared.value), left.column("part")[0].as_py()
            predictive(part, chances(part, right, levels), levels, hash((seed, round_, number)) & 0x7FFFFFFF, burn + 1, burn)
            return _up(part, number, shared.value)

        return run

    def parent(levels: Levels, customers: int, opened: int, round_: int):
        def run(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            order = np.argsort(table.column("part").to_numpy(), kind="stable").tolist()
            dishes = [np.frombuffer(table.column("dishes")[k].as_py(), np.uint64) for k in order]
            sent = np.concatenate([_unpress(table.column("tables")[k].as_py(), "u4")[0] for k in order])
            first, place = distinct(np.concatenate(dishes))
            n = np.bincount(place, sent, len(first)).astype(np.int64)
            rng, seating = np.random.default_rng([seed, round_, bucket]), Seating(levels.discount0)
            g = spread(np.random.default_rng([seed, round_, 1 << 20]), np.array([opened]), levels.strength, levels.discount0)[0]  # the same in each bucket
            weight = np.full(len(n), levels.discount0 * g * base)
            t = seating.draw(rng, n, weight, seating.first(n, weight))
            own = ((n - levels.discount0 * t) / (levels.strength + customers)).astype(np.float32)[place]
            ends = np.cumsum([len(d) for d in dishes])
            return pa.table({
                "part": pa.array([table.column("part")[k].as_py() for k in order], pa.int64()), "bucket": pa.array([bucket] * len(order), pa.int64()),
                "chance": pa.array([own[e - len(d) : e].tobytes() for d, e in zip(dishes, ends)], pa.binary()), "opened": pa.array([int(t.sum()), *[0] * (len(order) - 1)], pa.int64()),
            })

        return run

    for round_ in range(max(rounds, 1)):
        if answers is None:
            sent = asked.groupBy("part").applyInArrow(open_all, _UP)
        else:
            levels.draw_hot(seed + round_)
            sent = asked.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(sampler(levels, round_), _UP)
        sent = stored(sent, "language-up")
        if answers is not None:
            discard(parent_rows)
        known = sent.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("once"), F.lit(0)).alias("once"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice")).first()
        tables = dict.fromkeys((int(h) for h in layout.hot), 0)
        for r in sent.where("bucket = -1 and length(dishes) > 0").select("dishes", "tables").toLocalIterator():  # one row of hot contexts for each part
            for h, t in zip(np.frombuffer(r["dishes"], np.uint64).tolist(), np.frombuffer(r["tables"], np.int64).tolist()):
                tables[h] += t
        now = Levels(strength, discount_of(known["once"], known["twice"]), levels.discount0, tables)
        parent_rows = stored(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(parent(now, known["sent"], parent_tables, round_), "part long, bucket long, chance binary, opened long"), "language-parent")
        discard(sent)
        parent_tables = parent_rows.agg(F.coalesce(F.sum("opened"), F.lit(0)).alias("t")).first()["t"]
        now.floor = (strength + now.discount0 * parent_tables) * base / (strength + known["sent"])
        answers, levels = parent_rows.select("part", "bucket", "chance"), now

    levels.draw_hot(seed + rounds)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        part, number = Part(left, shared.value), left.column("part")[0].as_py()
        chance = predictive(part, chances(part, right, levels), levels, hash((seed, rounds, number)) & 0x7FFFFFFF, sweeps, burn)
        log = np.log10(chance).astype(np.float32)
        of_context = np.where(part.contexts == START, -1, part.total)
        out = []
        for (_, lo, hi), run in zip(part.asked, part.runs):
            place = part.place[lo:hi]
            out.append(_press(log[place], run, of_context[part.context[place[np.r_[0, np.cumsum(run)[:-1]]]]]))
        return pa.table({"part": pa.array([number] * len(out), pa.int64()), "block": pa.array([b for b, _, _ in part.asked], pa.int64()), "payload": pa.array(out, pa.binary())})

    answered = stored(asked.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(answer, "part long, block long, payload binary"), "language-answers")
    discard(asked_rows)
    discard(parent_rows)
    below, of_end = float(np.log10(train_tokens + vocabulary + 1)), float(np.log10(train_ends + 1))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, absent, held, n, times, owner = _unpress(left.column("own")[0].as_py(), "i8 u1 u1 i8 u4 u2")
        order = np.argsort(right.column("part").to_numpy(), kind="stable").tolist()
        got = [_unpress(right.column("payload")[k].as_py(), "f4 u4 i8") for k in order]
        score = np.concatenate([g[0] for g in got]).astype(np.float64)
        before = np.concatenate([np.repeat(g[2], g[1]) for g in got])  # training count of the pair's context, -1 for the start
        log = np.where(before < 0, 0.0, np.log10(np.maximum(before, 0) + 1.0))
        sums = lambda x: np.bincount(owner, np.repeat(x, times), len(ids))
        known = sums((before > 0).astype(float)).astype(np.int64) + (train_ends > 0)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=absent.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(n), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(ids), train_tokens, np.int64)), "base_score": pa.array(sums(log) + of_end - n * below), "score": pa.array(sums(score)),
        })

    return own_rows.select("block", "own").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(gather, schema)
