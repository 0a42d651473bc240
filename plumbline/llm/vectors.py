"""Shared by the operators on embeddings: usable vectors, packing into blocks, blocks in pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector is non-null, has only finite components, and is not zero."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def largest(column: str = "embedding") -> Column:
    """The largest absolute component of a vector."""
    return F.array_max(F.transform(F.col(column), lambda v: F.abs(v)))


def block_of(key: Column, blocks: int) -> Column:
    """A block for each row, dealt by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The matrix in half the bytes, if every number is the same in single precision."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float32)
    return half if np.array_equal(half.astype(np.float64), x) else x


def packed(rows: DataFrame, block: Column, extra: str | None = None) -> DataFrame:
    """One row for each block: ``block``, ``n``, ``dim``, and ids, ``extra`` numbers and vectors as bytes."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        x = matrix(table.column("embedding"))
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        other = table.column("extra").to_numpy().astype(np.int64)
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "n": pa.array([len(ids)], pa.int64()),
            "dim": pa.array([x.shape[1]], pa.int64()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "extra": pa.array([other.tobytes()], pa.binary()),
            "data": pa.array([_narrow(x).tobytes()], pa.binary()),
        })

    rows = rows.select("vec_id", "embedding", (F.col(extra) if extra else F.lit(0)).cast("long").alias("extra"), block.cast("long").alias("block"))
    return rows.groupBy("block").applyInArrow(run, "block long, n long, dim long, ids binary, extra binary, data binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, extra numbers and vectors of a packed row."""
    kind = np.float64 if len(row["data"]) == 8 * row["n"] * row["dim"] else np.float32
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["extra"], np.int64), np.frombuffer(row["data"], kind).astype(np.float64).reshape(row["n"], row["dim"])
