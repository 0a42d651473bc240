"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision only near the threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, short_batches, stored
from .vectors import block_of, packed, unpacked, usable

_TILE = 1024
#: 127 * 127 * 1024 is below 2**24.
_EXACT = 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is in [0.5, 1): exact, and its norm neither under- nor overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scales, norms of what they stand for, and norms of the error."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def tile_products(qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 tiles: single precision holds sums of up to ``_EXACT`` components exactly, double their total."""
    total = np.zeros((len(qx), len(qy)))
    for k in range(0, qx.shape[1], _EXACT):
        total += qx[:, k : k + _EXACT].astype(np.float32) @ qy[:, k : k + _EXACT].astype(np.float32).T
    return total


def tile_pairs(x: np.ndarray, y: np.ndarray, threshold: float):
    """Yield (rows of x, rows of y) whose cosine in double precision is at least ``threshold``.

    With x = x' + e and y = y' + f, x.y is at most x'.y' + |e||y'| + |x'||f| + |e||f|. A pair whose bound is below the
    threshold (less 1e-9 for rounding) is out for sure; the others are computed from the vectors. The vectors
    must be finite and not zero; any size will do.
    """
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, hx, ex = quantise(x / nx[:, None])
    qy, sy, hy, ey = quantise(y / ny[:, None])
    for a in range(0, len(x), _TILE):
        for b in range(0, len(y), _TILE):
            ra, rb = slice(a, a + _TILE), slice(b, b + _TILE)
            bound = tile_products(qx[ra], qy[rb])
            bound *= sx[ra][:, None]
            bound *= sy[rb][None, :]
            bound += (ex[ra] * hy[rb].max())[:, None]
            bound += ((hx[ra] + ex[ra]).max() * ey[rb])[None, :]
            i, j = np.nonzero(bound >= threshold - 1e-9)
            for lo in range(0, len(i), 1 << 16):
                ii, jj = i[lo : lo + (1 << 16)] + a, j[lo : lo + (1 << 16)] + b
                cosine = (x[ii] * y[jj]).sum(axis=1) / (nx[ii] * ny[jj])
                good = cosine >= threshold
                if good.any():
                    yield ii[good], jj[good]


def _spanning(a: np.ndarray, b: np.ndarray, root: dict[int, int], out: list[tuple[int, int]]) -> None:
    for u, v in zip(a.tolist(), b.tolist()):
        u0, v0 = u, v
        while (r := root.get(u, u)) != u:
            root[u] = u = root.get(r, r)
        while (r := root.get(v, v)) != v:
            root[v] = v = root.get(r, r)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((u0, v0))


def _block_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """Per pair of blocks: rows (a, null, links) with the weight linked to class a, and (a, b, 0) that span the components."""

    def run(table: pa.Table) -> pa.Table:
        a_out, b_out, n_out = [], [], []
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        i, size_i, x = unpacked(rows[0])
        j, size_j, y = unpacked(rows[-1])
        same = len(rows) == 1
        if x.shape[1] == y.shape[1]:
            linked_i, linked_j = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
            root: dict[int, int] = {}
            span: list[tuple[int, int]] = []
            for r, c in tile_pairs(x, y, threshold):
                if same:
                    r, c = r[r != c], c[r != c]
                np.add.at(linked_i, r, size_j[c])
                if not same:
                    np.add.at(linked_j, c, size_i[r])
                _spanning(i[r], j[c], root, span)
            for ids, linked in ((i, linked_i), *(() if same else ((j, linked_j),))):
                some = np.flatnonzero(linked)
                a_out += ids[some].tolist()
                b_out += [None] * len(some)
                n_out += linked[some].tolist()
            a_out += [s[0] for s in span]
            b_out += [s[1] for s in span]
            n_out += [0] * len(span)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64()), "links": pa.array(n_out, pa.int64())})

    count = blocks.select(F.max("block").alias("m")).first()["m"]
    if count is None:
        return blocks.select(F.col("block").alias("a"), F.col("block").alias("b"), F.col("n").alias("links")).limit(0)
    pair = F.transform(F.sequence(F.lit(0), F.lit(int(count)).cast("long")), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    spread = blocks.select("*", F.explode(pair).alias("pair")).select("*", "pair.i", "pair.j").drop("pair")
    return spread.groupBy("i", "j").applyInArrow(run, "a long, b long, links long")


def near_embeddings(rows: DataFrame, threshold: float = 0.9, numbers_per_block: int = 1 << 19) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows`` (vec_id, embedding).

    Vectors are linked if their cosine in double precision is at least ``threshold``. Equal vectors become one class
    with its smallest id and its size (the join of a vector with its class is by sort-merge, whose skewed keys Spark splits at run time); classes are dealt into blocks of a bounded number of rows, and one task
    compares two blocks (of about ``numbers_per_block`` components), tile by tile. Blocks travel in single precision where that is exact. A task sends one count for each class and the links that span
    its components, never all pairs.

    Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing, and so do
    vectors of different lengths with each other; a null id gives a null component and kept true, and takes no
    part; rows that repeat an id count as vectors of their own; an empty table gives no rows; further columns are ignored.
    """
    short_batches(rows.sparkSession)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = base.where(usable() & F.col("vec_id").isNotNull())
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).withColumn("dim", F.size("embedding")), "embedding-class")
    member = stored(good.join(classes.select("embedding", "rep", "size"), "embedding").select("vec_id", "rep", "size"), "embedding-member")
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    block = F.lit(None).cast("long")
    start = 0
    for dim, n in sorted(dims.items()):  # blocks of one length of vector each
        k = -(-n // max(256, numbers_per_block // dim))
        block = F.when(F.col("dim") == dim, block_of(F.col("vec_id"), k) + start).otherwise(block)
        start += k
    blocks = stored(packed(classes.select(F.col("rep").alias("vec_id"), "embedding", "size", "dim"), block, "size"), "embedding-block")
    found = stored(_block_links(blocks, threshold), "embedding-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("linked")).withColumnRenamed("a", "rep")
    edges = found.where("b is not null").select("a", "b").unionByName(member.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    tree = components(edges, "embedding")
    counts = classes.select("rep", "size").join(links, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    per_row = member.select("vec_id", "rep").distinct().join(counts, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = base.select("vec_id").join(per_row, "vec_id", "left").join(tree.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL for the rows of ``op8_embeddings``: all pairs.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM m LEFT JOIN n USING (vec_id)
"""
