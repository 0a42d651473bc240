"""Calibration over streams: mergeable metrics in event-time windows. An extension; batch frames work the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, clipped


def windowed_scores(rows: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Log loss, Brier score, and the sums of Spiegelhalter's statistic for each window (and ``by``); rows later than the watermark are dropped.

    ``rows`` has ts, s and y; state is a few sums for each window and key."""
    s, y = clipped(F.col("s")), F.col("y").cast("double")
    timed = rows.withWatermark(ts, late) if rows.isStreaming else rows
    loss = -(y * F.log(s) + (1 - y) * F.log1p(-s))
    out = timed.groupBy(F.window(ts, length, slide), *by).agg(
        F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg((s - y) * (s - y)).alias("brier"),
        F.sum((y - s) * (1 - 2 * s)).alias("z_top"), F.sum(F.pow(1 - 2 * s, 2) * s * (1 - s)).alias("z_var"),
    )
    return out.select(F.col("window.start").alias("start"), *by, "n", "log_loss", "brier", (F.col("z_top") / F.sqrt("z_var")).alias("z"))


def windowed_bins(rows: DataFrame, edges: Sequence[float], length: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts, mean score and event rate by window and fixed score bin: what ECE over a stream is made of."""
    timed = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(ts, length), bin_index(F.col("s"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("p"), F.avg("y").alias("r"))


def session_scores(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Count, log loss and Brier score of each session: rows of a key (``by``) with no pause as long as ``gap``."""
    s, y = clipped(F.col("s")), F.col("y").cast("double")
    timed = rows.withWatermark(ts, late) if rows.isStreaming else rows
    loss = -(y * F.log(s) + (1 - y) * F.log1p(-s))
    out = timed.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg((s - y) * (s - y)).alias("brier"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "log_loss", "brier")


def recomputed(rows: DataFrame, metric: Callable[[DataFrame, int], None], checkpoint: str, history: str):
    """Start a query that appends each micro-batch to ``history`` (Parquet) and calls ``metric`` on the whole history and the batch's id.

    For metrics that do not merge, such as those over quantile bins. A batch that is run again after a failure replaces its own part."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(history)
        metric(batch.sparkSession.read.parquet(history).drop("batch"), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
