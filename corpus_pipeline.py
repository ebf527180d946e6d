"""From raw documents to packed sequences: toxicity, quality, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.llm import minhash, mixing, packing, quality, toxicity
from evidrill.llm.common import discard, free_name, materialize, table
from evidrill.llm.registry import pack_settings


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score below 0.5)."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.score_documents(docs, model, score).where(F.col(score) < 0.5).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their neighbours vote for (score of at least 0.3)."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality")
    return quality.score_documents(docs, model, column=score).where(F.col(score) >= 0.3).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 hold together."""
    return minhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered shares of sources, languages and topics."""
    return mixing.sample_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sampled documents with their token ids, in sequences of 1024 tokens."""
    return packing.pack_documents(docs, pack_settings())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The learned stages have no SQL; the pipeline is tested against the operators run one by one on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
        last = docs
    return docs
