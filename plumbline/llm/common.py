"""Shared pieces of the text operators: table access, shared-folder tables, hashing, components."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows in one Arrow batch sent to Python: texts can be long, so batches are short.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark alone (any store it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the memory of a Python worker by the rows of a batch, and send it this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else on one machine one of our own.

    Without that setting a cluster of several machines has no such folder that we know: an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.abspath(os.path.join("spark-warehouse", "checkpoints"))
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


_written: dict[str, SparkSession] = {}


def clear_stored() -> None:
    """Delete all tables that operators have stored so far: for long sessions, once their results are written or collected.

    At the interpreter's exit it is done anyway.
    """
    while _written:
        path, spark = _written.popitem()
        _drop(spark, path)


atexit.register(clear_stored)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def divided(df: DataFrame, condition: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """``stored`` for the rows that meet a condition and for the others, written in one pass as two tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    df.withColumn("side", condition.cast("int")).write.partitionBy("side").parquet(path)
    out = []
    for side in (1, 0):
        own = f"{path}/side={side}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)  # no such row: an empty table
        out.append(spark.read.schema(df.schema).parquet(own))
        out[-1]._stored_at = own
        _written[own] = spark
    return out[0], out[1]


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` returned, once nothing reads it any more, and let Spark delete shuffle files of finished steps."""
    spark = _written.pop(df._stored_at, None)
    if spark is not None:
        _drop(spark, df._stored_at)
        released(spark)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: its cleaner follows the driver's garbage collection."""
    spark._jvm.System.gc()


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key has remainder -1 and so trains."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def sample_key(key: Column, seed: str) -> Column:
    """A reproducible shuffle order that does not follow the id order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


# ---------------------------------------------------------------- hashing of words in numpy

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end bytes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; and word offsets by row.

    The hash is a polynomial over random byte codes modulo 2**64, finished by a bijection,
    so equal words have equal hashes in every batch and on every machine.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * up, out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that the ``text`` of one holds about ``limit`` bytes at most, but one whole row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` long): rows (``node``, ``component``), the smallest node reachable.

    Alternating large-star and small-star rounds. Every step is a grouped minimum (combined before
    its shuffle) joined back to the edges; the edges of a hub meet in that join, whose skewed keys Spark splits at run time. Only
    nodes with an edge are returned; loops and repeated edges do no harm; no edges give no rows.
    """
    cur = stored(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    mark = None
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        cur = stored(small.where("a <> b").distinct(), f"{name}-star")
        seen = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
