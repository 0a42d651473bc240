"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix64, pieces, short_batches, stored, words

#: Most rows of a band, most coordinates of a signature, and the chance that a pair at the threshold shares no band.
ROWS, COORDINATES, MISSED = 8, 512, 4e-5
_PLACE = mix64(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): as many rows as the signature has room for with so many bands that a pair at the threshold is missed
    with probability ``MISSED`` at most: (32, 8) at 85, (56, 8) at 80."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    for rows in range(ROWS, 0, -1):
        miss = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log(miss)) if miss > 0 else 1
        if rows == 1 or bands * rows <= COORDINATES:
            return bands, rows


def _permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers for each pair of odd multipliers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def _scattered(x: np.ndarray) -> np.ndarray:
    return _permuted(x, 0x7FEB352D, 0x846CA68B)


def _ordered(x: np.ndarray) -> np.ndarray:
    return _permuted(x, 0x85EBCA6B, 0xC2B2AE35)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its word shingles; shorter texts are one shingle, texts without words none."""
    from .common import text_bytes

    hashes, _, _, first = words(*text_bytes(column))
    if len(hashes) >= width:
        joined = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            joined += hashes[k : len(hashes) - width + 1 + k] * _PLACE[k]
        joined = mix64(joined)
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= width:
            out.append(np.unique(joined[lo : hi - width + 1]))
        elif hi > lo:
            own = np.uint64(hi - lo) + np.sum(hashes[lo:hi] * _PLACE[5 : 5 + hi - lo], dtype=np.uint64)
            out.append(mix64(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, size: int = 256) -> np.ndarray:
    """Circulant MinHash: the first permutation scatters the shingles; coordinate k is the least value of the second
    permutation after shifting it k places around its circle of 2**32."""
    places = _scattered((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(places), 1024):
        out = np.minimum(out, _ordered(places[None, start : start + 1024] + shift).min(axis=1))
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows.shape[1]):
        keys = mix64(keys ^ rows[:, k] * _PLACE[k])
    return keys.view(np.int64)


def _sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([band_keys(signature(s, bands * rows), bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _joined(root: dict[int, int], a: int) -> int:
    while root[a] != a:
        root[a] = a = root[root[a]]
    return a


def links_of(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that hold a block of documents together: exact similarity of every pair, each component as a tree."""
    root = {i: i for i in ids}
    out = []

    def link(a: int, b: int) -> None:
        a, b = _joined(root, a), _joined(root, b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))

    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) <= 12:
        for i in range(len(ids)):
            for j in range(i):
                small, large = sorted((int(sizes[i]), int(sizes[j])))
                if 100 * small >= percent * large and _joined(root, ids[i]) != _joined(root, ids[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        link(ids[i], ids[j])
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(every, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # counts stay below 2**24: exact
    step = 8192
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    whole = both.astype(np.int64)
    near = 100 * whole >= percent * (sizes[:, None] + sizes[None, :] - whole)
    for i, j in np.argwhere(np.tril(near, -1)):
        link(ids[i], ids[j])
    return out


def _verify(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Exact links inside candidate clusters: ``members`` has doc_id, set_key, text, cluster, blocks, place."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if table.num_rows:
            table = table.combine_chunks()
            column = table.column("text").chunk(0)
            keys, ids, where = table.column("set_key").to_pylist(), table.column("doc_id").to_pylist(), table.column("task").to_pylist()
            groups: dict[str, list[int]] = {}
            for k, w in enumerate(where):
                groups.setdefault(w, []).append(k)
            for rows in groups.values():
                sets = shingle_sets(column.take(pa.array(rows)))
                own: dict[int, np.ndarray] = {}
                for k, s in zip(rows, sets):  # of rows that repeat an id only the one whose set this is
                    if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == keys[k]:
                        own[ids[k]] = s
                if len(own) > 1:
                    out += links_of(list(own), list(own.values()), percent)
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    ranks = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.transform(ranks, lambda k: F.concat_ws("/", F.col("cluster").cast("string"), F.least(k, F.col("place")).cast("string"), F.greatest(k, F.col("place")).cast("string")))
    spread = members.select("doc_id", "set_key", "text", F.explode(pair).alias("task"))
    return spread.withColumn("part", F.pmod(F.xxhash64("task"), F.lit(block)).cast("int")).groupBy("part").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, rows_per_block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of five-word shingles, on
    full sets. Steps, each linear in the input: one pass makes set sizes, set keys and band keys, as many as the threshold needs; equal sets
    become one class with its smallest id; classes that share a band key are tied to the key's smallest class, and the
    components of these ties are candidate clusters; only the texts of clusters are read again, each once, and
    every pair inside a cluster is verified exactly. A large cluster is dealt in blocks of about
    ``rows_per_block``, one task for two blocks, and only links that make a spanning tree leave a task.

    Edge cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer than five words is
    one shingle; rows with the same id share a component; a null id gives a null component and kept true;
    an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(_sketches(plain, *banding(percent)), "minhash-sketch")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "minhash-class")
    copies = usable.select("set_key", "doc_id").join(classes.select("set_key", "rep"), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keyed = classes.select("rep", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    ties = keyed.join(hubs.select("band", "hub"), "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(ties, "minhash-candidates").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")

    sized = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sized = sized.withColumn("blocks", F.ceil(F.col("n") / F.lit(rows_per_block)).cast("int"))
    members = clusters.join(sized.select("cluster", "blocks"), "cluster").join(classes.select("rep", "set_key"), "rep")
    members = members.withColumn("place", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int"))
    members = stored(members, "minhash-members")
    tasks = members.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    texts = plain.join(members.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")  # members have no size bound: never broadcast
    links = _verify(texts, percent, int(max(16, tasks // 500)))
    found = components(links.unionByName(copies), "minhash-links")
    out = sketch.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL for the rows of ``op5_minhash``: every pair that shares a shingle is compared.
NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, md5(unnest(sh)) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)
"""
