"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes, reranked by floats."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_key, short_batches, stored
from .vectors import block_of, largest, matrix, packed, unpacked, usable

#: Most substrings of a code, and bits by which a probed value may differ from the query's substring.
TABLES, REACH = 224, 2


def learn_rotation(x: np.ndarray, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Iterative quantisation: an orthogonal rotation under which signs lose least, from a random start."""
    start = np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1]))
    r = np.linalg.qr(start)[0]
    for _ in range(rounds):
        signs = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ signs)
        r = u @ vt
    return r


@dataclass
class CodeModel:
    """Scale, mean and rotations (one bit for each column), bits of a substring, and what the probes fitted.

    Inner products become angles by one more component: a row x of norm up to ``scale`` is (x, sqrt(scale^2 - |x|^2)) / scale, a
    query (x, 0) / |x|.
    """

    scale: float
    mean: np.ndarray
    rotations: np.ndarray
    bits: int
    tables: int = TABLES
    radius: int = 0

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.scale
        size = np.linalg.norm(x, axis=1)
        if query:
            most = np.abs(x).max(axis=1)
            x = x / np.where(most > 0, most, 1.0)[:, None]
            size = np.linalg.norm(x, axis=1)
            return np.hstack([x / np.where(size > 0, size, 1.0)[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(1 - size * size, 0.0))[:, None]])

    def substrings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The code of each vector, as ``tables`` numbers of ``bits`` bits."""
        ones = ((self.lifted(x, query) - self.mean) @ self.rotations[:, : self.tables * self.bits]) >= 0
        return ones.reshape(len(x), self.tables, self.bits) @ (1 << np.arange(self.bits))


class MultiIndex:
    """One table for each substring of the codes: which rows have which value there."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values, self.bits = values.astype(np.uint16), bits
        self.wide = _wide(self.values)
        self.order = np.argsort(self.values, axis=0, kind="stable").astype(np.int32).T.ravel()
        counts = np.stack([np.bincount(self.values[:, j], minlength=1 << bits).astype(np.int32) for j in range(values.shape[1])])
        self.starts = np.concatenate([np.zeros((len(counts), 1), np.int32), np.cumsum(counts, axis=1, dtype=np.int32)], axis=1)
        every = np.arange(1 << bits)
        self.flips = every[np.bitwise_count(every) <= REACH]

    def probed(self, code: np.ndarray) -> np.ndarray:
        """Every row with a substring within ``REACH`` bits of the query's: by the pigeonhole principle all rows whose codes differ
        in fewer than (REACH + 1) * tables bits, and of the others those whose difference is spread unevenly."""
        near = code.astype(np.int64)[:, None] ^ self.flips[None, :]
        first = np.take_along_axis(self.starts, near, 1)
        size = (np.take_along_axis(self.starts, near + 1, 1) - first).ravel()
        first = (first + len(self.values) * np.arange(len(near))[:, None]).ravel()
        at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        seen = np.zeros(len(self.values), bool)
        seen[self.order[at]] = True
        return np.flatnonzero(seen)

    def apart(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.wide[rows] ^ _wide(code.astype(np.uint16)[None, :])).sum(axis=1)


def _wide(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(values, ((0, 0), (0, -values.shape[1] % 4)))).view(np.uint64)


def fit_codes(rows: DataFrame, dim: int, scale: float, per_block: int, sample: int = 4096, probes: int = 96, k: int = 20, recall: float = 0.97) -> CodeModel:
    """Rotations from a bounded sample of rows, chosen by a hash of the id; radius and number of tables from a bounded set of probe vectors.

    The probes are compared with every row exactly (a set of fixed size against all rows, in one pass). The radius is the code
    distance that ``recall`` of their true ``k`` nearest rows stay within, and there are as many substrings as
    probing needs to meet that share of them (at most ``TABLES``). A substring has four bits more than log2 of a block's rows, at most 16.
    """
    key = sample_key(F.col("vec_id"), "codes")
    got = rows.select("vec_id", "embedding").orderBy(key, "vec_id").limit(sample).collect()
    ids = np.array([r["vec_id"] for r in got], np.int64)
    x = np.array([r["embedding"] for r in got], float).reshape(len(got), dim)
    bits = int(np.clip(round(np.log2(max(per_block, 2))) + 4, 6, 16))
    model = CodeModel(scale, np.zeros(dim + 1), np.zeros((dim + 1, 0)), bits)
    lifted = model.lifted(x, False)
    model.mean = lifted.mean(axis=0)
    needed = -(-TABLES * bits // (dim + 1))
    model.rotations = np.hstack([learn_rotation(lifted - model.mean, seed) for seed in range(needed)])
    model.rotations = model.rotations[:, np.random.default_rng(9).permutation(model.rotations.shape[1])]  # so that a substring mixes rotations
    probe_ids, probe = ids[:probes], x[:probes]
    code = model.substrings(probe, True).astype(np.uint16)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, own = matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                score = (probe / scale) @ (y / scale).T
            score[probe_ids[:, None] == own[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(own) - 1), axis=1)[:, :k]
            q, c = np.repeat(np.arange(len(probe)), top.shape[1]), top.ravel()
            some, back = np.unique(c, return_inverse=True)
            apart = np.bitwise_count(code[q] ^ model.substrings(y[some]).astype(np.uint16)[back])
            met = apart <= REACH
            first = np.where(met.any(axis=1), met.argmax(axis=1), TABLES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(score[q, c], pa.float64()), pa.array(apart.sum(axis=1), pa.int32()), pa.array(first, pa.int32())], names=["q", "score", "apart", "first"]
            )

    near = rows.select("vec_id", "embedding").mapInArrow(run, "q long, score double, apart int, first int").where(F.col("score") > float("-inf"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("place") <= k)
    found = near.select("apart", "first").collect()  # at most k for each probe
    if found:
        first, apart = np.sort([r["first"] for r in found]), np.array([r["apart"] for r in found])
        model.tables = int(min(first[min(int(recall * len(first)), len(first) - 1)] + 1, TABLES))
        # the radius holds for the whole code; fewer substrings have their share of it, and a margin of three standard deviations
        share = min(np.quantile(apart, recall) / (TABLES * bits), 1.0)
        whole = model.tables * bits
        model.radius = int(min(np.ceil(share * whole + 3 * np.sqrt(whole * share * (1 - share)) * (1 - model.tables / TABLES) ** 0.5), whole))
    return model


def nearest(rows: DataFrame, k: int = 20, every: int = 20, rows_per_block: int = 16_384, queries_per_block: int = 4096, **options) -> DataFrame:
    """query_id, rank, vec_id, score, visited, reranked: for each row whose id is divisible by ``every`` its ``k`` nearest other rows by inner product.

    All rows are indexed, in blocks; a task probes one block with a block of queries, and the results of a query
    (at most ``k`` a block) are merged. Probed rows are checked on whole codes and those within the radius reranked; the radius grows for a query
    that finds fewer than ``k`` rows in a block, at last to all rows. ``visited`` and ``reranked`` count a query's probed and reranked rows.
    Scores are inner products in double precision of the original vectors, summed in one fixed order, so
    equal vectors tie exactly and ties go to the smaller id. Work is queries times rows times the share that probing visits.

    Edge cases: null, zero and non-finite vectors and rows with a null id take no part; vectors of each length are
    searched among themselves, with an index of their own; rows that repeat an id are candidates of their own, never of a query with
    that id; fewer candidates than ``k`` are all returned; an empty table gives no rows; further columns are ignored.
    """
    spark = rows.sparkSession
    short_batches(spark, 4096)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    asked = F.count(F.when(F.col("vec_id") % every == 0, 1))
    sizes = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), asked.alias("asked"), F.max(largest()).alias("most")).collect()  # one row a length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited long, reranked long")
    for r in sorted(sizes, key=lambda r: r["dim"]):
        if r["asked"]:
            out = out.unionByName(_nearest(base.where(F.size("embedding") == r["dim"]), r["dim"], r["n"], r["asked"], r["most"], k, every, rows_per_block, queries_per_block, options))
    return out


def _nearest(base: DataFrame, dim: int, n: int, asked: int, most: float, k: int, every: int, rows_per_block: int, queries_per_block: int, options: dict) -> DataFrame:
    spark = base.sparkSession
    scale = float(most) * np.sqrt(dim)  # no norm is larger
    if not np.isfinite(scale):
        scale = float(most)
    size = base.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / F.lit(scale)) * (v / F.lit(scale))))).alias("m")).first()["m"]
    scale = max(scale * max(size, 1e-300), 5e-324)
    per_block = -(-n // max(1, -(-n // rows_per_block)))
    shared = spark.sparkContext.broadcast(fit_codes(base, dim, scale, per_block, k=k, **options))  # matrices of dim x (TABLES * bits) at most

    def dealt(df: DataFrame, count: int, size: int):
        return packed(df, block_of(F.col("vec_id"), max(1, -(-count // size))))

    index = stored(dealt(base, n, rows_per_block), "neighbours-index")
    queries = stored(dealt(base.where(F.col("vec_id") % every == 0), asked, queries_per_block), "neighbours-queries")
    n_index, n_query = max(1, -(-n // rows_per_block)), max(1, -(-asked // queries_per_block))
    spread = index.select("*", F.lit(0).alias("side"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("q"))
    spread = spread.unionByName(queries.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_index - 1).cast("long"))).alias("i"), F.col("block").alias("q")))

    def run(table: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in table.to_pylist()}
        out: dict[str, list] = {c: [] for c in ("query_id", "vec_id", "score", "visited", "reranked")}
        if len(sides) == 2:
            model = shared.value
            ids, _, x = unpacked(sides[0])
            wanted, _, asked_x = unpacked(sides[1])
            tables = MultiIndex(model.substrings(x), model.bits)
            whole = model.bits * model.tables
            for query, vector, code in zip(wanted, asked_x, model.substrings(asked_x, True)):
                rows, radius = tables.probed(code), model.radius
                rows = rows[ids[rows] != query]
                apart = tables.apart(code, rows)
                found = rows[apart <= radius]
                if len(found) < k:
                    rows = np.flatnonzero(ids != query)
                    apart = tables.apart(code, rows)
                    while len(found) < k and radius < whole:
                        radius = min(whole, radius + model.bits)
                        found = rows[apart <= radius]
                visited, reranked = len(rows), len(found)
                if not reranked:
                    continue
                score = (x[found] * vector).sum(axis=1)
                if len(found) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    some = score >= least
                    found, score = found[some], score[some]
                best = np.lexsort((ids[found], -score))[:k]
                counted = np.zeros((2, len(best)), np.int64)
                counted[:, 0] = visited, reranked  # once for this block
                for column, values in zip(out.values(), (np.full(len(best), query), ids[found[best]], score[best], counted[0], counted[1])):
                    column.append(values)
        return pa.table({c: np.concatenate(v).astype(kind) if v else np.zeros(0, kind) for (c, v), kind in zip(out.items(), (np.int64, np.int64, np.float64, np.int64, np.int64))})

    near = spread.groupBy("i", "q").applyInArrow(run, "query_id long, vec_id long, score double, visited long, reranked long")
    own = Window.partitionBy("query_id")
    near = near.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id")))
    near = near.withColumn("visited", F.sum("visited").over(own)).withColumn("reranked", F.sum("reranked").over(own))
    return near.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "visited", "reranked")
