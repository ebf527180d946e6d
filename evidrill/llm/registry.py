"""Queries that apply each training-data operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.llm import chat, embeddings, language, minhash, mixing, packing, quality, rules, scoring, toxicity
from evidrill.llm.common import key_remainder, table

#: Folder of the public tokenizers' files; the same on every machine.
TOKENIZERS = os.environ.get("EVIDRILL_TOKENIZERS", "")


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_settings() -> packing.PackSettings:
    import public_tokenizers

    return packing.PackSettings(vocabulary=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.score_documents(docs, scoring.LatticeSettings(vocabulary=tokenizer_file("byte_bpe_50k.tiktoken")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (key_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn_dictionaries(docs.select("doc_id", "text", "lang"))
    found = language.predict_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", (key_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.add_probability(docs)
    return mixed.select("doc_id", "topic", F.round("probability", 9).alias("probability"), "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, pack_settings())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (key_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge_documents(docs, rules.plan_cascade(docs))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PLANTED).alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(planted)))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.MinHashSettings(shingle=4))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_scoring, op2_toxicity, op3_language, op4_embedding_dedup, op5_mixing, op6_packing, op7_quality, op8_quality_rules, op9_chat, op10_minhash_dedup, pipeline)
    return {f.__name__: f for f in own}


#: The rest has no SQL: learned models, compression, hashed candidates and packing are tested against brute force,
#: exact round trips and held-out labels instead.
def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.oracle_sql(),
        "op8_quality_rules": rules.ORACLE_SQL,
        "op9_chat": chat.ORACLE_SQL,
        "op10_minhash_dedup": minhash.oracle_sql(4),
    }
