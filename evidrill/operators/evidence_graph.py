"""Property graphs of questions and their evidence: runtime graph, gold overlay, batch status, claim audit by order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.functions.text import norm_id, slug, stable_id
from evidrill.operators.graph import align_claims, overall_state


def inference_graph(questions: DataFrame, evidence: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, status) of each sample without any gold data.

    ``questions(sample_id, question)``, ``evidence(sample_id, source_file, page_number, granularity, content, score)``,
    ``sources(source_id, filename)``. Equal spans of a source page are one node, with the best observation (score, then
    finer granularity) and all granularities it was seen at. Evidence of a source that is not admitted fails its sample.
    """
    admitted = sources.select("source_id", norm_id("filename").alias("_f"))
    seen = evidence.withColumn("_f", norm_id("source_file")).join(admitted, "_f", "left").drop("_f")
    failed = seen.where("source_id IS NULL").select("sample_id").distinct()
    good = seen.join(failed, "sample_id", "left_anti")
    span = F.concat(F.lit("evidence::"), "source_id", F.lit("::p"), F.col("page_number").cast("string"), F.lit("::"), stable_id("content"))
    best = F.max_by(F.struct("granularity", "content", "score"), F.struct("score", (-F.col("granularity")).alias("g"), "content"))
    spans = good.withColumn("node_id", span).groupBy("sample_id", "node_id", "source_id").agg(best.alias("b"), F.array_join(F.transform(F.array_sort(F.collect_set("granularity")), lambda g: g.cast("string")), ",").alias("granularities"))
    asked = questions.join(failed, "sample_id", "left_anti").select("sample_id", F.concat(F.lit("question::"), F.col("sample_id").cast("string")).alias("node_id"), F.lit("Question").alias("node_type"), F.col("question").alias("content"), F.lit(None).cast("string").alias("granularities"))
    source_id = F.concat(F.lit("source::"), F.col("source_id").cast("string"))
    used = good.select("sample_id", source_id.alias("node_id"), F.lit("SourceDocument").alias("node_type"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("granularities")).distinct()
    found = spans.select("sample_id", "node_id", F.lit("EvidenceSpan").alias("node_type"), F.col("b.content").alias("content"), "granularities")
    edges = spans.select("sample_id", F.col("node_id").alias("source"), source_id.alias("target"), F.lit("EVIDENCE_FROM_SOURCE").alias("edge_type"))
    count = spans.groupBy("sample_id").agg(F.count("*").alias("spans"))
    status = questions.select("sample_id").join(failed.withColumn("f", F.lit(True)), "sample_id", "left").join(count, "sample_id", "left")
    state = F.when(F.col("f"), "failed").when(F.col("spans") > 0, "success").otherwise("empty_evidence")
    return asked.unionByName(used).unionByName(found), edges, status.select("sample_id", state.alias("build_status"), F.coalesce("spans", F.lit(0)).alias("spans"))


def evaluation_graph(nodes: DataFrame, edges: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runtime graph with its gold overlay: decision, risk labels, claims and the gold span, added where absent.

    ``gold(sample_id, source_id, page_number, anchor_text_span, expected_decision, risk_labels, claims)``.
    """
    sample = F.col("sample_id").cast("string")
    decision = F.concat(F.lit("decision::"), sample, F.lit("::expected::"), slug("expected_decision"))
    named = F.concat(F.lit("evidence::"), "source_id", F.lit("::p"), F.col("page_number").cast("string"), F.lit("::"), stable_id("anchor_text_span"))
    gold, span = gold.withColumn("_span", named), F.col("_span")  # a column of its own: lambdas take no Python function
    source = F.concat(F.lit("source::"), F.col("source_id").cast("string"))
    claim = lambda i: F.concat(F.lit("claim::"), sample, F.lit("::gold::supported::"), (i + 1).cast("string"))
    one = lambda node, kind: F.struct(node.alias("node_id"), F.lit(kind).alias("node_type"))
    labels = F.transform(F.coalesce("risk_labels", F.array().cast("array<string>")), lambda r: one(F.concat(F.lit("risk::"), slug(r)), "RiskLabel"))
    claims = F.transform(F.coalesce("claims", F.array().cast("array<string>")), lambda c, i: one(claim(i), "Claim"))
    all_nodes = gold.select("sample_id", F.explode(F.concat(F.array(one(decision, "Decision"), one(span, "EvidenceSpan"), one(source, "SourceDocument")), labels, claims)).alias("n")).select("sample_id", "n.*").distinct()
    fresh = all_nodes.join(nodes.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_anti").select("sample_id", "node_id", "node_type", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("granularities"))
    question = F.concat(F.lit("question::"), sample)
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"))
    risks = F.transform(F.coalesce("risk_labels", F.array().cast("array<string>")), lambda r: edge(question, F.concat(F.lit("risk::"), slug(r)), "HAS_RISK"))
    backed = F.transform(F.coalesce("claims", F.array().cast("array<string>")), lambda c, i: edge(claim(i), span, "SUPPORTED_BY"))
    more = gold.select("sample_id", F.explode(F.concat(F.array(edge(question, decision, "EXPECTS"), edge(span, source, "EVIDENCE_FROM_SOURCE")), risks, backed)).alias("e")).select("sample_id", "e.*")
    return nodes.unionByName(fresh), edges.unionByName(more).distinct()


def batch_summary(status: DataFrame) -> DataFrame:
    """Samples of a batch run by their status; a failure is a row, not the end of the run."""
    return status.groupBy("build_status").agg(F.count("*").alias("samples"), F.sum("spans").alias("spans"))


def claims_by_order(claims: DataFrame, evidence: DataFrame, orders: Sequence[str], top: int = 4) -> DataFrame:
    """Claim states of each answer against the first ``top`` evidence of each order (for instance before and after)."""
    parts = None
    for o in orders:
        view = evidence.where(F.col(o) <= top).select("answer_id", "ctype", "cvalue")
        states = overall_state(align_claims(claims, view)).withColumn("evidence_order", F.lit(o))
        parts = states if parts is None else parts.unionByName(states)
    return parts
