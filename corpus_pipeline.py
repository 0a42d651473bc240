"""A corpus pipeline of five of the text operators: from raw documents to encoded training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import langid, minhash, mixing, secrets, sentencepieces
from plumbline.llm.common import discard, stored, table
from plumbline.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents are near-duplicates from this Jaccard similarity, in percent.
NEAR = 80
#: Language scores below this are rejected, as are texts without a letter.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the filters are learned from the stage's own input.

    Null and empty texts and texts without a letter go; each row is decided by its own text, so repeated rows stay or go
    together; a null id, lang or source changes nothing but what is learned; no rows give no rows; of the columns those of documents are returned.
    """
    found = langid.identify_languages(docs, langid.fit_languages(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Rows that repeat an id: equal texts are one document (with the least lang, source and n_chars); different texts are
    documents of their own, of which the least keeps the id's place in the order and the others come after all ids.
    Rows without an id all stay, and so do texts without words; no rows give no rows; of the columns those of documents are returned.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null")
    # a table of its own, so that its size is known when the joins are planned: few repeats are broadcast, and no text is shuffled for them
    repeated = stored(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    once = named.join(repeated, "doc_id", "left_anti").withColumn("key", F.col("doc_id").cast("long"))
    again = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    later = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    again = again.withColumn("key", F.when(place == 1, F.col("doc_id").cast("long")).otherwise(later)).select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars", "key")
    every = once.select(*COLUMNS, "key").unionByName(again.select(*COLUMNS, "key"))
    kept = minhash.near_duplicates(every.select(F.col("key").alias("doc_id"), "text"), percent=NEAR).where("kept").select(F.col("doc_id").alias("key"))
    return every.join(kept, "key", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced, and n_chars counted anew.

    A null text stays null and keeps its n_chars; repeated rows are redacted alike; no rows give no rows; of the columns those
    of documents are returned.
    """
    found = secrets.scan_secrets(docs, keep=COLUMNS[1:], replace=True)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Rows that share id, source and size (repeats, or rows without an id) get among them just the entries that the mixture gave
    them, the most to the least text. Null and empty texts have size 0 and are never taken; a null source is a source of its own; no
    rows give no rows; of the columns those of documents are returned.
    """
    docs = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    mixed = mixing.mix_sources(docs.select("doc_id", "source", "text"), keep=("source",))
    times = mixed.groupBy("doc_id", "source", "size").agg(*[F.count(F.when(F.col("entries") >= k, 1)).alias(f"at_least_{k}") for k in (1, 2)]).where("at_least_1 > 0")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    taken = docs.alias("d").join(times.alias("t"), on).select(*[F.col(f"d.{c}").alias(c) for c in (*COLUMNS, "size")], "at_least_1", "at_least_2")
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("text", "lang", "n_chars"))
    taken = taken.withColumn("place", place).withColumn("entries", (F.col("place") <= F.col("at_least_1")).cast("int") + (F.col("place") <= F.col("at_least_2")).cast("int"))
    return taken.where("entries > 0").withColumn("entry", F.explode(F.sequence(F.lit(1), F.col("entries")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents, by digests of their ids and of the decoded text, with their source.

    One row for each row, a null text as empty; no rows give no rows; further columns are ignored.
    """
    return sentencepieces.encode_documents(docs, PIECE_MODEL, keep=("source",))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixture", mixture), ("pieces", pieces)]

#: Language identification and piece encoding have no SQL; a test holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what a stage leaves is a table in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
