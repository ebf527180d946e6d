from __future__ import annotations

from pyspark.sql import functions as F

from evidrill.operators import anchors as A
from evidrill.operators import evidence_graph as G


def test_candidates(spark):
    rows = [("s", 1, 512, "text", "推荐剂量为 10 mg/kg，每日一次。阿奇霉素静脉滴注，疗程七天，注意监测肝肾功能。"), ("s", 1, 128, "text", "推荐剂量为  10 mg/kg，每日一次。阿奇霉素静脉滴注，疗程七天，注意监测肝肾功能。"), ("s", 0, 128, "text", "阿奇霉素。" * 20), ("s", 2, 128, "text", "# 阿奇霉素"), ("t", 1, 128, "text", "没有任何主题词的一句长话。" * 5)]
    got = A.anchor_candidates(spark.createDataFrame(rows, "source_id string, page_number int, granularity int, block_type string, content string"), {"drug": ["阿奇霉素"], "dose": ["剂量"]}).collect()
    assert [(r.source_id, r.page_number, r.granularity, r.matched_topics) for r in got] == [("s", 1, 128, "dose,drug")] and got[0].candidate_id.startswith("CAND-")
    status = {r.source_id: r.status for r in A.source_status(spark.createDataFrame([("s", 1)], "source_id string, x int"), spark.createDataFrame([("s",), ("u",)], "source_id string")).collect()}
    assert status == {"s": "candidates_ready", "u": "no_candidates"}


def test_promotion_order_of_reasons(spark):
    text = "足够长的锚点文本，可以追溯到原文"
    rows = [("b", "1", "accepted", text, f"前文 {text} 后文"), ("a", "2", "accepted", text, text), ("a", "3", "rejected", text, text), ("a", "4", "accepted", "短", "短"), ("a", "5", "accepted", "乱码乱码乱码???乱码乱码", "x"), ("a", "6", "accepted", text + "别处", text), ("a", "7", None, text, text)]
    got = {r.candidate_id: r.reason for r in A.promotion(spark.createDataFrame(rows, "source_id string, candidate_id string, decision string, anchor_text string, raw_text string")).collect()}
    assert got == {"1": "duplicate_anchor", "2": "promoted", "3": "not_accepted", "4": "too_short", "5": "garbled", "6": "not_traceable", "7": "not_accepted"}


def test_roles_and_provenance(spark):
    df = spark.createDataFrame([("A", ["dose"], "scope", "个体化处方"), ("B", ["x"], "scope", "处方"), ("C", ["x"], "s", "其他")], "anchor_id string, claim_types array<string>, scope string, boundary string")
    d = A.boundary_decision(F.col("claim_types"), F.col("scope"), F.col("boundary"), ["dose"], ["缺乏"], ["处方"])
    got = {(r.anchor_id, r.role): r.expected_decision for r in A.candidate_roles(df, d).collect()}
    assert got["A", "boundary"] == "insufficient_evidence" and got["B", "boundary"] == "boundary_refusal" and got["C", "boundary"] == "review_required" and got["A", "supported"] == "allow_supported_answer"
    c = spark.createDataFrame([(1, "s", "h"), (2, "s", "other"), (3, "z", "h")], "id int, source_id string, sha string")
    failed = {r.id: r.failed for r in A.provenance_failures(c, spark.createDataFrame([("s", "h")], "source_id string, sha string"), ["sha"]).collect()}
    assert failed == {1: [], 2: ["sha"], 3: ["unknown_source"]}


def test_evidence_graphs(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "sample_id long, question string")
    e = spark.createDataFrame([(1, "G.pdf", 4, 512, "same span", 0.5), (1, "g.pdf ", 4, 128, "Same  span", 0.9), (2, "unknown.pdf", 1, 128, "x", 0.1)], "sample_id long, source_file string, page_number int, granularity int, content string, score double")
    nodes, edges, status = G.inference_graph(q, e, spark.createDataFrame([("S1", "g.PDF")], "source_id string, filename string"))
    assert {r.sample_id: (r.build_status, r.spans) for r in status.collect()} == {1: ("success", 1), 2: ("failed", 0), 3: ("empty_evidence", 0)}
    span = nodes.where("node_type = 'EvidenceSpan'").first()
    assert span.granularities == "128,512" and span.content == "Same  span" and edges.count() == 1
    gold = spark.createDataFrame([(1, "S1", 4, "same span", "allow", ["Dose Risk"], ["c1", "c2"])], "sample_id long, source_id string, page_number int, anchor_text_span string, expected_decision string, risk_labels array<string>, claims array<string>")
    n2, e2 = G.evaluation_graph(nodes, edges, gold)
    kinds = {r.node_type: r.n for r in n2.where("sample_id = 1").groupBy("node_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"Question": 1, "SourceDocument": 1, "EvidenceSpan": 1, "Decision": 1, "RiskLabel": 1, "Claim": 2}
    assert e2.count() == 5 and {r.build_status: r.samples for r in G.batch_summary(status).collect()} == {"success": 1, "failed": 1, "empty_evidence": 1}
