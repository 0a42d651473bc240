"""Calibration frames over the driver tables, and a synthetic portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import expit
from ..operators.solvers import root_1d


def orders_frame(spark: SparkSession, sf_dir: str, digits: int | None = None) -> DataFrame:
    """row_id, s, w, grade, y from ``orders``: a score from the price, an outcome from a hash of the key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = 1 / (1 + F.exp(-(F.lit(-1.2) + 5.0 * (F.col("o_totalprice") / 500000.0 - 0.5))))
    base = o.select(
        F.col("o_orderkey").alias("row_id"), s.alias("s"), (1 + F.col("o_custkey") % 4).cast("double").alias("w"), F.col("o_orderpriority").alias("grade"),
        (((F.col("o_orderkey") * 7919 + 104729) % 100003).cast("double") / 100003.0).alias("u"),
    )
    chance = 1 / (1 + F.exp(-(0.7 * (F.log("s") - F.log(1 - F.col("s"))) - 0.4)))
    out = base.withColumn("y", F.when(F.col("u") < chance, 1.0).otherwise(0.0))
    if digits is not None:
        out = out.withColumn("s", F.round("s", digits))
    return out.select("row_id", "s", "w", "grade", "y")


def portfolio(spark: SparkSession, n: int = 5000, event_rate: float = 0.03, slope: float = 0.7, intercept: float = 0.0, asymmetry: float = 0.4, location: float = -3.2, scale: float = 1.1, seed: int = 42) -> DataFrame:
    """row_id, s, y, p_true: scores whose log-odds are normal, a true curve steeper below than above, anchored at an event rate.

    With slope 1, asymmetry 0 and intercept 0 the scores are the true probabilities, whatever the event rate.
    Draws come from hashes of the row id, so they do not depend on partitions."""

    def uniform(k: int):
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * 3.141592653589793 * uniform(2))
    base = spark.range(n).select(F.col("id").alias("row_id"), expit(location + scale * normal).alias("s"), uniform(3).alias("u"))
    if not 0 < event_rate < 1:
        raise ValueError("the event rate lies strictly between 0 and 1")
    z = slope * (1 + asymmetry) * F.log("s") - slope * F.log1p(-F.col("s")) + F.lit(float(intercept))

    def value(c: float):
        p = expit(z + F.lit(float(c)))
        m, d = base.agg(F.avg(p), F.avg(p * (1 - p))).first()
        return m - event_rate, d

    exact = slope == 1 and asymmetry == 0 and intercept == 0
    truth = F.col("s") if exact else expit(z + F.lit(root_1d(value, 0.0, -60.0, 60.0)))
    return base.withColumn("p_true", truth).withColumn("y", F.when(F.col("u") < F.col("p_true"), 1.0).otherwise(0.0)).drop("u")


