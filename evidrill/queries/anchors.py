"""Anchor and evidence-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions.rules import PICTURE_PLACEHOLDER, REFERENCE_HEADING
from evidrill.operators import anchors as A
from evidrill.operators import evidence_graph as G
from evidrill.operators import retrieval as R
from evidrill.queries import views as V
from evidrill.queries.retrieval import _RRF

TOPICS = {"alpha": ("that", "nicht"), "beta": ("WITH",), "gamma": ("zzzz",)}


def topic_matches(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).select("doc_id", F.explode(A.match_topics("content", TOPICS)).alias("t"))
    return c.select("doc_id", "t.topic", F.array_join("t.terms", ",").alias("terms"))


TOPIC_MATCHES = "WITH " + V.CHUNKS + """, t AS (SELECT doc_id, 'alpha' AS topic, array_to_string(list_filter(['nicht', 'that'], lambda w: contains(lower(content), w)), ',') AS terms FROM chunks
UNION ALL SELECT doc_id, 'beta', CASE WHEN contains(lower(content), 'with') THEN 'WITH' ELSE '' END FROM chunks) SELECT * FROM t WHERE terms <> ''"""


def anchor_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).select(F.col("source_file").alias("source_id"), "page_number", F.lit(512).alias("granularity"), F.lit("text").alias("block_type"), "content")
    return A.anchor_candidates(c, TOPICS).select("candidate_id", "source_id", "page_number", "matched_topics", F.length("raw_text").alias("chars"))


ANCHOR_CANDIDATES = "WITH " + V.CHUNKS + rf""", t AS (SELECT source_file, page_number, trim(regexp_replace(content, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM chunks
), u AS (SELECT *, trim(regexp_replace(t, '^\s{{0,3}}#{{1,6}}\s*', '')) AS plain, concat_ws(',', CASE WHEN contains(lower(t), 'that') OR contains(lower(t), 'nicht') THEN 'alpha' END, CASE WHEN contains(lower(t), 'with') THEN 'beta' END, CASE WHEN contains(lower(t), 'zzzz') THEN 'gamma' END) AS topics FROM t)
SELECT DISTINCT 'CAND-' || left(sha256(source_file || '|' || page_number || '|' || t), 20) AS candidate_id, source_file AS source_id, page_number, topics AS matched_topics, CAST(length(t) AS INTEGER) AS chars FROM u
WHERE page_number > 0 AND length(t) BETWEEN 30 AND 6000 AND NOT regexp_matches(t, '{PICTURE_PLACEHOLDER}') AND NOT regexp_matches(t, '{REFERENCE_HEADING}') AND len(regexp_extract_all(t, '{A.DOT_LEADERS}')) < 2
  AND NOT (length(t) <= 160 AND NOT regexp_matches(plain, '{A.SENTENCE_SIGNAL}') AND NOT regexp_matches(plain, '{A.DOSE_SIGNAL}')) AND topics <> ''"""


def promotion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reviewed anchors: the label is the author's decision, the whole text the anchor."""
    d = V.chunks(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
    reviews = d.select(F.col("source_file").alias("source_id"), F.col("doc_id").alias("candidate_id"), F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").alias("decision"), F.sha2("content", 256).alias("anchor_text"), F.sha2("content", 256).alias("raw_text"))
    return A.promotion(reviews).groupBy("reason").agg(F.count("*").alias("n"))


PROMOTION_REASONS = "WITH " + V.CHUNKS + """, r AS (SELECT doc_id, source_file, content, coalesce(quality = 1, false) AS ok FROM chunks LEFT JOIN labels USING (doc_id)
), d AS (SELECT *, row_number() OVER (PARTITION BY content, ok ORDER BY source_file, doc_id) AS n FROM r)
SELECT CASE WHEN NOT ok THEN 'not_accepted' WHEN n > 1 THEN 'duplicate_anchor' ELSE 'promoted' END AS reason, count(*) AS n FROM d GROUP BY 1"""


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = V.questions(spark, sf).select(F.col("query_id").alias("sample_id"), F.col("query").alias("question"))
    top = R.rrf(V.routed(spark, sf), 60, 20).where("rank <= 4").join(V.chunks(spark, sf), "candidate_key")
    e = top.select(F.col("query_id").alias("sample_id"), "source_file", "page_number", F.lit(512).alias("granularity"), "content", F.col("rrf_score").alias("score"))
    sources = V.chunks(spark, sf).select(F.col("source_file").alias("filename"), F.concat(F.lit("S-"), "source_file").alias("source_id")).distinct().where("filename <> 'src7'")
    return G.inference_graph(q, e, sources)


def inference_graph_status(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[2]


INFERENCE_GRAPH_STATUS = "WITH " + _RRF + """, e AS (SELECT query_id, bool_or(source_file = 'src7') AS bad, count(DISTINCT (source_file, page_number, content)) AS spans FROM fused JOIN chunks USING (candidate_key) WHERE frank <= 4 GROUP BY query_id)
SELECT query_id AS sample_id, CASE WHEN bad THEN 'failed' WHEN spans > 0 THEN 'success' ELSE 'empty_evidence' END AS build_status, CASE WHEN coalesce(bad, true) THEN 0 ELSE spans END AS spans FROM questions LEFT JOIN e USING (query_id)"""


def inference_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, _ = _graph(spark, sf)
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"))


INFERENCE_GRAPH_NODES = "WITH " + _RRF + """, e AS (SELECT query_id, source_file, page_number, content, bool_or(source_file = 'src7') OVER (PARTITION BY query_id) AS bad FROM fused JOIN chunks USING (candidate_key) WHERE frank <= 4)
SELECT 'Question' AS node_type, count(*) AS nodes FROM questions WHERE query_id NOT IN (SELECT query_id FROM e WHERE bad)
UNION ALL SELECT 'SourceDocument', count(*) FROM (SELECT DISTINCT query_id, source_file FROM e WHERE NOT bad) UNION ALL SELECT 'EvidenceSpan', count(*) FROM (SELECT DISTINCT query_id, source_file, page_number, content FROM e WHERE NOT bad)"""

QUERIES = {
    "topic_matches": (topic_matches, TOPIC_MATCHES),
    "anchor_candidates": (anchor_candidates, ANCHOR_CANDIDATES),
    "promotion_reasons": (promotion_reasons, PROMOTION_REASONS),
    "inference_graph_status": (inference_graph_status, INFERENCE_GRAPH_STATUS),
    "inference_graph_nodes": (inference_graph_nodes, INFERENCE_GRAPH_NODES),
}
