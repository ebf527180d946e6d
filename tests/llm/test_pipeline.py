"""The pipeline's stages against the operators run one by one, and on odd tables."""

from __future__ import annotations

import corpus_pipeline
from evidrill.llm import minhash, mixing, quality, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    packed = corpus_pipeline.run(spark, sf)
    clean = toxicity.score_documents(docs, toxicity.learn(docs, labels), "t").where("t < 0.5").drop("t").cache()
    good = quality.score_documents(clean, quality.learn(clean, labels), column="q").where("q >= 0.3").drop("q").cache()
    unique = minhash.keep_one_of_each(good).cache()
    mixed = mixing.sample_documents(unique)
    assert unique.columns == docs.columns and 0 < unique.count() < docs.count()
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_nulls_and_repeats(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", None, None, None), (3, None, "en", "a", 0), (None, text, "en", "a", 1), (5, "", None, "b", 0), (6, text[::-1] * 50, "xx", "b", 9)]
    path = folder(spark, tmp_path / "odd", rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(1) <= 1 and 2 not in kept
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} <= {1, 3, None, 5, 6} and all(len(r.ids) == 4 * r.length for r in out)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [])).count() == 0
