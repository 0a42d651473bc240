"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters that separate words, besides the blank: tab, line feed, vertical tab, form feed, return.
_OTHER_SPACE = "\t\n\x0b\x0c\r"


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    flat = F.trim(F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE)))
    return F.when(F.length(flat) > 0, F.size(F.split(flat, " +"))).otherwise(0).cast("long")


def mixture_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): weights by code point order, null last, repeating.

    Water filling in closed form: a source is full at ``repeats`` times its size; with the sources sorted
    by full size over weight, source i is full exactly if pouring up to its level needs no more than the
    budget. One row per source, so the two windows over all sources hold a small table.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    marks = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(marks, (F.col("place") % len(weights) + 1).cast("int")))
    out = out.withColumn("full", F.col("source_size") * F.lit(float(repeats))).withColumn("level", F.col("full") / F.col("weight"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    out = out.withColumn("is_full", F.sum("full").over(upto) + F.col("level") * (F.sum("weight").over(every) - F.sum("weight").over(upto)) <= F.col("budget"))
    poured = F.sum(F.when(F.col("is_full"), F.col("full")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("weight"))).over(every)
    water = (F.col("budget") - poured) / F.nullif(open_weight, F.lit(0.0))
    return out.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(water * F.col("weight"))).select("source", "source_size", "budget", "target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    rows_per_bucket: int = 200_000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often, and in which virtual order, each document enters a mixture of its sources.

    Each source sends its documents in a shuffled order, up to ``repeats`` times over. An entry's
    virtual finish time is the cumulative size of its source so far over the source's target; the mix
    is the sequence by finish time, cut where its sizes pass the budget (``share`` of all sizes).
    Equal rates mean that every source has sent about its target at the cut.

    Returns doc_id, size, source_size, target, taken (size times entries), entries, first_finish, and
    the columns in ``keep``. Order and cut depend on ids and sizes alone, so reruns agree.

    Prefix sums go in two steps: sums by bucket (combined before the shuffle), then inside a bucket.
    A bucket is a range of the shuffle order or of virtual time, so a hot source spreads over buckets.

    Edge cases: a null or empty text has size 0, enters 0 times and takes 0; a null source is a source
    of its own, last in order; null ids are kept (their turn comes from their size alone); repeated
    rows count one by one; an empty table gives no rows; further columns are ignored unless kept.
    """
    kept = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "source", "text")]
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[F.col(c).alias(f"kept_{c}") for c in kept])
    base = base.withColumn("turn", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))))
    base = stored(base, "mix-rows")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = mixture_targets(per_source.select("source", "source_size"), weights, share, repeats)
    rows = base.count()
    fine = max(8, min(1 << 16, rows // rows_per_bucket + 1))

    # virtual finish times: prefix sums of sizes within a source, by range of the shuffle order
    base = base.withColumn("bucket", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * fine / F.lit(1 << 32)).cast("int"))
    by_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0))).drop("part")
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "ahead", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = base.withColumn("within", F.sum("size").over(inside))
    timed = (
        timed.alias("t")
        .join(starts.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("t.bucket") == F.col("s.bucket")))
        .select("t.doc_id", "t.source", "t.turn", "t.size", (F.col("within") + F.col("ahead")).alias("sent"), "s.source_size", "s.target", "s.budget", *[F.col(f"t.kept_{c}").alias(f"kept_{c}") for c in kept])
    )
    timed = stored(timed, "mix-timed")
    finish = [((F.col("sent") + F.col("source_size") * k).cast("double") / F.col("target")).alias("finish") for k in range(repeats)]

    # the cut: sizes by slice of virtual time, then row by row inside the one slice that holds the cut
    slices = fine * 4
    entries = timed.where("size > 0 and target > 0").select("turn", "doc_id", "size", "budget", F.explode(F.array(*[F.struct(f, F.lit(k).alias("epoch")) for k, f in enumerate(finish)])).alias("e"))
    entries = entries.select("turn", "doc_id", "size", "budget", "e.finish", "e.epoch").withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices)).cast("int"))
    by_slice = entries.groupBy("slice").agg(F.sum("size").alias("part"), F.max("budget").alias("budget"))
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_slice = by_slice.withColumn("upto", F.sum("part").over(ahead)).where("upto > budget").orderBy("slice").limit(1).first()
    order = ["finish", "turn", "doc_id", "size", "epoch"]
    if cut_slice is None:
        taken = F.lit(repeats)
        out = timed.withColumn("entries", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0))
    else:
        here, before, budget = cut_slice["slice"], cut_slice["upto"] - cut_slice["part"], cut_slice["budget"]
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = entries.where(F.col("slice") == here).withColumn("upto", F.sum("size").over(running) + F.lit(before)).where(F.col("upto") <= F.lit(budget))
        last = edge.agg(F.max(F.struct(*order)).alias("last")).first()["last"]

        def enters(k: int):
            at = F.least(F.floor(finish[k] * slices), F.lit(2 * slices)).cast("int")
            earlier = at < here
            if last is None:
                return earlier
            key = F.struct(finish[k], F.col("turn"), F.col("doc_id"), F.col("size"), F.lit(k).alias("epoch"))
            edge_key = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["turn"]).alias("turn"), F.lit(last["doc_id"]).cast(timed.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["epoch"]).alias("epoch"))
            return earlier | ((at == here) & (key <= edge_key))

        count = sum((F.when(enters(k), 1).otherwise(0) for k in range(1, repeats)), F.when(enters(0), 1).otherwise(0))
        out = timed.withColumn("entries", F.when((F.col("size") > 0) & (F.col("target") > 0), count).otherwise(0))
    return out.select(
        "doc_id",
        "size",
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * F.col("entries")).alias("taken"),
        F.col("entries").cast("int").alias("entries"),
        finish[0].alias("first_finish"),
        *["source"] * ("source" in keep),
        *[F.col(f"kept_{c}").alias(c) for c in kept],
    )


#: DuckDB SQL for the rows of ``op1_mix``.
MIX_SQL = """
WITH base AS (
  SELECT doc_id, source, size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', size)) AS turn
  FROM (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents)),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1] AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS filled, source_size * 2.0::DOUBLE / weight AS level,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s1),
s3 AS (SELECT *, sum(filled) OVER w + level * (sum(weight) OVER () - sum(weight) OVER w) <= budget AS is_full
       FROM s2 WINDOW w AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s4 AS (SELECT source, source_size, budget, CASE WHEN is_full THEN filled ELSE
         (budget - sum(CASE WHEN is_full THEN filled ELSE 0 END) OVER ())
         / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) * weight END AS target FROM s3),
timed AS (SELECT b.*, s4.source_size, s4.target, s4.budget,
            sum(size) OVER (PARTITION BY b.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
          FROM base b JOIN s4 ON b.source IS NOT DISTINCT FROM s4.source),
entries AS (SELECT turn, doc_id, size, budget, epoch, CAST(sent + source_size * epoch AS DOUBLE) / target AS finish
            FROM timed, (VALUES (0), (1)) e(epoch) WHERE size > 0 AND target > 0),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM entries),
got AS (SELECT doc_id, turn, size, count(*) AS entries FROM cut WHERE upto <= budget GROUP BY doc_id, turn, size)
SELECT t.doc_id, t.size, t.source_size, coalesce(t.target, 0.0) AS target, CAST(t.size * coalesce(g.entries, 0) AS BIGINT) AS taken
FROM timed t LEFT JOIN got g ON t.doc_id IS NOT DISTINCT FROM g.doc_id AND t.turn = g.turn AND t.size = g.size
"""
