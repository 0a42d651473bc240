"""The thin queries over whole tables: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embeddings, langid, language_model, minhash, mixing, neighbours, quality, secrets, sentencepieces, toxicity
from .common import table

#: A public tokenizer's file, where its package has it; a parameter of the operator, as the files are never copied here.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_languages(docs))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_language(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_language": op4_language,
        "op5_minhash": op5_minhash,
        "op6_neighbours": op6_neighbours,
        "op7_perplexity": op7_perplexity,
        "op8_embeddings": op8_embeddings,
        "op9_pieces": op9_pieces,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.MIX_SQL, "op5_minhash": minhash.NEAR_SQL, "op8_embeddings": embeddings.EMBEDDING_SQL}
