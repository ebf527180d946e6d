"""Scans, sinks and assets on real files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidrill.functions import text as X
from evidrill.operators import contracts as K
from evidrill.operators import retrieval as R
from evidrill.plans import service
from evidrill.sources import files as S
from evidrill.sources import scratch
from evidrill.streaming import events as ST


def test_csv_is_one_immutable_file(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", 'b"c'], "line\nbreak"), (1, [], "ü")], "id int, l array<string>, t string").repartition(2)
    path = f"file://{tmp_path}/review.csv"
    assert S.write_csv(df, path, ["id", "l", "t"], ["l"], order=["id"]) and not S.write_csv(df, path, ["id", "l", "t"], ["l"], order=["id"])
    raw = (tmp_path / "review.csv").read_bytes()
    assert raw.startswith("﻿id,l,t\n1,".encode()) and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["review.csv"]
    got = S.read_csv(spark, path, ["id", "l", "t"], ["l"]).orderBy("id").collect()
    assert [(r.id, r.l, r.t) for r in got] == [("1", [], "ü"), ("2", ["a", 'b"c'], "line\nbreak")]
    with pytest.raises(K.ContractError):
        S.write_csv(df.where("id = 1"), path, ["id", "l", "t"], ["l"])


def test_objects_manifests_and_caches(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"a": 1, "b": {"c": "x"}}, indent=1))
    assert S.read_json_object(spark, str(tmp_path / "one.json"), "a int, b struct<c:string>").first() == (1, ("x",))
    (tmp_path / "m.jsonl").write_text('{"source_id": "s1"}\n{"source_id": "s2"}\n')
    assert S.read_manifest(spark, str(tmp_path / "m.jsonl"), "source_id string").count() == 2
    (tmp_path / "m2.jsonl").write_text('{"source_id": "s1"}\n{"source_id": "s1"}\n')
    with pytest.raises(K.ContractError):
        S.read_manifest(spark, str(tmp_path / "m2.jsonl"), "source_id string")
    for i, v in enumerate(("v1", "v1", "v2")):
        (tmp_path / "cache").mkdir(exist_ok=True)
        (tmp_path / "cache" / f"{i}.json").write_text(json.dumps({"key": i, "version": v}))
    assert S.read_cache(spark, str(tmp_path / "cache"), "key int, version string", {"version": "v1"}).count() == 2


def test_settings(spark, tmp_path):
    (tmp_path / "env").write_text('# a comment\nKEY=one\nexport OTHER = "two words"\nKEY=three\nnot a setting\nEMPTY=\n')
    assert S.read_env(spark, str(tmp_path / "env")) == {"KEY": "three", "OTHER": "two words", "EMPTY": ""}


def test_assets(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0])], "id int, embedding array<double>")
    path = f"file://{tmp_path}/asset"
    assert S.write_asset(df, path).first().vectors == 2 and S.load_asset(spark, path).count() == 2
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(K.ContractError):
        S.load_asset(spark, path)


def test_export_needs_unique_keys(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "id int")
    assert [r.id for r in S.ordered_export(df, "id").collect()] == [1, 2, 3]
    with pytest.raises(K.ContractError):
        S.ordered_export(df.union(df), "id")


def test_scratch_tables_are_in_the_named_folder_and_go(spark, tmp_path):
    t = scratch.write_once(spark.range(3).toDF("id"), "t")
    assert t.scratch_path.startswith(spark.conf.get("spark.checkpoint.dir")) and t.count() == 3
    scratch.discard(t, None)
    with pytest.raises(Exception):
        spark.read.parquet(t.scratch_path).count()


def test_pieces_without_an_end_are_left_out(spark):
    pieces = [(1, 0, 'data: {"ty'), (1, 1, 'pe": "start"}\n\nda'), (1, 2, 'ta: {"type": "do'), (2, 0, "data: {}")]
    got = ST.reassemble(spark.createDataFrame(pieces, "session_id long, piece int, data string")).collect()
    assert [(r.session_id, r.line) for r in got] == [(1, 'data: {"type": "start"}')]


def test_stream_without_repeats(spark, tmp_path):
    spark.sql("SELECT id % 3 AS event_id, timestamp'2024-01-01 00:00:00' AS ts FROM range(9)").write.parquet(f"file://{tmp_path}/in")
    s = ST.without_repeats(spark.readStream.schema("event_id long, ts timestamp").parquet(f"file://{tmp_path}/in"))
    q = s.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [0, 1, 2]


def test_small_forms(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```", 10.0), (" {} ", 0.25)], "t string, x double")
    assert [(r.a, r.b) for r in df.select(X.strip_code_fence("t").alias("a"), X.canonical_number("x").alias("b")).collect()] == [('{"a": 1}', "10"), ("{}", "0.25")]
    j = spark.range(1).select(X.canonical_json(F.create_map(F.lit("b"), F.lit('"é'), F.lit("a"), F.lit(""))).alias("j")).first().j
    assert j == '{"a":"","b":"\\"é"}'


def test_service_prefers_the_boosted_fallback(spark):
    chunks = [("d::1", 128, "guide.pdf", 3, "text", "An unrelated sentence about the treatment plan, 治疗.", [1.0, 0.0]), ("d::2", 512, "NICE_NG143_Fever_in_under_5s.pdf", 4, "text", "paracetamol or ibuprofen for a child with fever 发热 布洛芬 对乙酰氨基酚 same", [-1.0, 0.0]), ("d::3", 128, "x.pdf", 1, "table", "| 布洛芬 |  剂量 |  治疗 |", [1.0, 0.1])]
    c = spark.createDataFrame(chunks, "candidate_key string, granularity int, source_file string, page_number int, block_type string, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "孩子发热能用布洛芬吗", [1.0, 0.0]), (2, "plain question", [1.0, 0.0])], "query_id long, query string, query_vector array<double>")
    got = {(r.query_id, r["rank"]): r.candidate_key for r in service.retrieve(c, q, 2).collect()}
    assert got[1, 1] == "d::2" and got[2, 1] == "d::1"
    assert "d::3" not in {r.candidate_key for r in service.retrieve(c, q, 2, include_tables=False).collect()}


def test_weights_outside_the_vocabulary_stop_the_job(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 9, 1.0), ("b", 1, 0.0)], "document_id string, token_id int, weight double")
    assert R.check_weights(df.where("token_id < 5"), 5).count() == 1
    with pytest.raises(Exception, match="token id out of range"):
        R.check_weights(df, 5).collect()
