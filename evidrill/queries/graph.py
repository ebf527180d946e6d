"""Constraint-graph queries: lexicon, postings, qualification, routing, expansion, rerank, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions.constraints import REJECTION, extract_constraints, local_clause, merge_constraints, stance
from evidrill.functions.text import split_claims
from evidrill.operators import graph as G
from evidrill.operators import retrieval as R
from evidrill.queries import views as V
from evidrill.sources.scratch import write_once

EXCLUSIVE = ("dose", "frequency", "route")
HIGH_RISK = ("dose", "medication")
CONTEXT = ("age_group", "clinical_condition")
ANCHORS = ("clinical_condition", "medication")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return V.chunks(spark, sf).select("candidate_key", "source_file", "page_number")


#: Texts whose constraints are known, beside whatever the documents hold: (owner, text, ((type, value), ...)).
PLANTED = (
    ("planted::1", "儿童支原体肺炎阿奇霉素静滴 10mg/kg，一天两次可以吗？", (("dose", "10mg/kg", "10mg/kg"), ("evidence_scope", "dose_guidance", "10mg/kg"), ("frequency", "bid", "一天两次"), ("route", "iv_infusion", "静滴"), ("patient_weight", "", ""))),
    ("planted::2", "阿奇霉素静点，10 mg/(kg.d)，qd。", (("dose", "10mg/kg/day", "10 mg/(kg.d)"), ("evidence_scope", "dose_guidance", "10 mg/(kg.d)"), ("frequency", "qd", "qd"), ("route", "iv_infusion", "静点"))),
    ("planted::3", "经48～72小时治疗症状无改善", (("monitoring_trigger", "nonresponse", "症状无改善"), ("monitoring_window", "48-72h", "48~72小时"))),
    ("planted::4", "infant 7.50 kg, next dose in 24h", (("monitoring_window", "24h", "24h"), ("patient_weight", "7.5kg", "7.50 kg"))),
)


def constraint_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern constraints of whole texts and of a few planted ones: merged, one row per (document, type, value)."""
    d = V.chunks(spark, sf).select(F.col("candidate_key").alias("owner_id"), F.lit("content").alias("scope"), F.col("content").alias("text"))
    planted = spark.createDataFrame([(o, "content", t) for o, t, _ in PLANTED], "owner_id string, scope string, text string")
    found = merge_constraints(extract_constraints(d.unionByName(planted)))
    return found.select("owner_id", "ctype", "cvalue", F.array_join("surface_forms", "|").alias("surface_forms"))


#: The patterns look around, which DuckDB's cannot; a document that holds what any of them needs shows up as a row.
CONSTRAINT_EXTRACT = "WITH " + V.CHUNKS + " SELECT * FROM (VALUES " + ", ".join(f"('{o}', '{t}', '{v}', '{x}')" for o, _, found in PLANTED for t, v, x in found if v) + r""") v(owner_id, ctype, cvalue, surface_forms)
UNION ALL SELECT candidate_key, 'unexpected', '', '' FROM chunks WHERE regexp_matches(content, '(?i)[0-9]\s*kg\b|[0-9]\s*h\b|\bqd\b|\bbid\b|both agents|simultaneously|[\x{4e00}-\x{9fff}]')"""


def lexicon_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return V.constraints(spark, sf).select("owner_id", "scope", "ctype", "cvalue", "strong")


LEXICON_CONSTRAINTS = "WITH " + V.CONSTRAINTS + " SELECT owner_id, scope, ctype, cvalue, strong FROM cons"


def constraint_postings(spark: SparkSession, sf: str) -> DataFrame:
    return G.postings(V.constraints(spark, sf))


CONSTRAINT_POSTINGS = "WITH " + V.CONSTRAINTS + " SELECT ctype, cvalue, count(DISTINCT owner_id) AS candidates FROM cons WHERE scope = 'context' GROUP BY ALL"


def adjacent_pages(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacent_pages(_candidates(spark, sf))


ADJACENT_PAGES = "WITH " + V.CHUNKS + ", p AS (SELECT DISTINCT source_file, page_number FROM chunks) SELECT p.source_file, p.page_number, b.page_number AS before, a.page_number AS after FROM p LEFT JOIN p b ON b.source_file = p.source_file AND b.page_number = p.page_number - 1 LEFT JOIN p a ON a.source_file = p.source_file AND a.page_number = p.page_number + 1"


def posting_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return G.posting_ranking(V.query_constraints(spark, sf), _candidates(spark, sf), V.constraints(spark, sf)).select("query_id", "candidate_key", "match_count", "type_count", "graph_rank")


POSTING_RANKING = "WITH " + V.CONSTRAINTS + """, h AS (SELECT query_id, owner_id AS candidate_key, count(*) AS match_count, count(DISTINCT ctype) AS type_count FROM qc JOIN xc USING (ctype, cvalue) GROUP BY ALL HAVING count(DISTINCT ctype) >= 2)
SELECT query_id, candidate_key, match_count, type_count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match_count DESC, source_file, page_number, candidate_key) AS INTEGER) AS graph_rank FROM h JOIN chunks USING (candidate_key)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return G.qualify_paths(V.query_constraints(spark, sf), _candidates(spark, sf), V.constraints(spark, sf))


def path_qualify(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).drop("signature", "candidate_condition")


_PATHS = V.CONSTRAINTS + """, own AS MATERIALIZED (
  SELECT x.owner_id, x.ctype, x.cvalue, bool_or(c.owner_id IS NOT NULL) AS in_content, bool_or(s.owner_id IS NOT NULL) AS in_source
  FROM xc x LEFT JOIN cc c ON c.owner_id = x.owner_id AND c.ctype = x.ctype AND c.cvalue = x.cvalue LEFT JOIN sc s ON s.owner_id = x.owner_id AND s.ctype = x.ctype AND s.cvalue = x.cvalue GROUP BY ALL
), m AS (
  SELECT query_id, owner_id AS candidate_key, ctype, cvalue, q.strong, in_content, in_source, ctype = 'medication_class' AND cvalue = 'antimicrobial' AS broad FROM qc q JOIN own USING (ctype, cvalue)
), st AS (
  SELECT query_id, candidate_key, count(*) AS match_count, count(DISTINCT ctype) AS type_count, count(*) FILTER (in_content) AS content_match_count, count(DISTINCT ctype) FILTER (in_content) AS content_type_count,
    bool_or(strong) AS strong, bool_or(ctype IN ('audit_domain', 'clinical_condition', 'medication') OR (ctype = 'medication_class' AND NOT broad)) AS specific, bool_or(in_content AND NOT broad) AS cs,
    bool_or(ctype = 'clinical_condition') AS hc, bool_or(ctype = 'medication_class') AS hm, bool_or(ctype = 'clinical_condition' AND in_source) AS cis, bool_or(ctype = 'clinical_condition' AND in_content) AS cic
  FROM m GROUP BY ALL
), f AS (
  SELECT st.*, q.query_id IS NOT NULL AS qcond, c.owner_id IS NOT NULL AS ccond, s.owner_id IS NOT NULL AS scond FROM st
  LEFT JOIN (SELECT DISTINCT query_id FROM qc WHERE ctype = 'clinical_condition') q ON q.query_id = st.query_id
  LEFT JOIN (SELECT DISTINCT owner_id FROM xc WHERE ctype = 'clinical_condition') c ON c.owner_id = candidate_key LEFT JOIN (SELECT DISTINCT owner_id FROM sc) s ON s.owner_id = candidate_key
), paths AS MATERIALIZED (
  SELECT query_id, candidate_key, source_file, page_number,
    CASE WHEN qcond AND ccond AND NOT hc THEN 'condition_conflict' WHEN type_count < 2 THEN 'insufficient_types' WHEN NOT strong THEN 'missing_strong_anchor' WHEN NOT specific THEN 'missing_specific_anchor'
      WHEN content_match_count = 0 THEN 'no_content_supported_match' WHEN NOT cs THEN 'broad_content_only' WHEN hc AND hm AND type_count = 2 THEN 'condition_class_only' ELSE 'qualified' END AS reason,
    CASE WHEN NOT qcond THEN 3 WHEN cis THEN 0 WHEN cic AND NOT scond THEN 1 WHEN cic THEN 2 ELSE 4 END AS tier, match_count, type_count, content_match_count, content_type_count
  FROM f JOIN chunks USING (candidate_key)
)"""
PATH_QUALIFY = "WITH " + _PATHS + " SELECT * FROM paths"


def _qualified(spark: SparkSession, sf: str) -> DataFrame:
    return write_once(path_qualify(spark, sf).where("reason = 'qualified'"), "paths")


def path_route_quota(spark: SparkSession, sf: str) -> DataFrame:
    return G.route_with_quotas(_qualified(spark, sf), 6, 2, 1).select("query_id", "candidate_key", "raw_rank", "route_decision", "route_rank")


_ROUTE = _PATHS + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, content_type_count DESC, content_match_count DESC, type_count DESC, match_count DESC, source_file, page_number, candidate_key) AS raw_rank FROM paths WHERE reason = 'qualified'
), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, page_number ORDER BY raw_rank) <= 1 AS s1 FROM o
), b AS (SELECT *, s1 AND sum(s1::INT) OVER (PARTITION BY query_id, source_file ORDER BY raw_rank) <= 2 AS s2 FROM a
), c AS (SELECT *, s2 AND sum(s2::INT) OVER (PARTITION BY query_id ORDER BY raw_rank) <= 6 AS sel FROM b
), d AS (SELECT *, coalesce(sum(sel::INT) OVER (PARTITION BY query_id, source_file, page_number ORDER BY raw_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ip, coalesce(sum(sel::INT) OVER (PARTITION BY query_id, source_file ORDER BY raw_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS iss, coalesce(sum(sel::INT) OVER (PARTITION BY query_id ORDER BY raw_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ia FROM c
), route AS MATERIALIZED (
  SELECT query_id, candidate_key, tier, type_count, content_type_count, CAST(raw_rank AS INTEGER) AS raw_rank, CASE WHEN sel THEN 'selected' WHEN ip >= 1 THEN 'source_page_quota' WHEN iss >= 2 THEN 'source_quota' ELSE 'total_quota' END AS route_decision, CAST(CASE WHEN sel THEN ia + 1 END AS BIGINT) AS route_rank FROM d
)"""
PATH_ROUTE_QUOTA = "WITH " + _ROUTE + " SELECT query_id, candidate_key, raw_rank, route_decision, route_rank FROM route"


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return write_once(G.select_with_quotas(path_qualify(spark, sf).where("reason = 'qualified'"), 6, 2, 1), "selected-paths")


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return R.rrf(V.routed(spark, sf), 60, 20)


def _expanded(spark: SparkSession, sf: str, selected: DataFrame) -> DataFrame:
    base = write_once(_fused(spark, sf).select("query_id", "candidate_key", "rank"), "fused")
    return G.expand_with_budget(base, selected.withColumnRenamed("route_rank", "graph_rank"), 20, 4)


def graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, _selected(spark, sf))


_EXPAND = _ROUTE + """, fused AS MATERIALIZED (SELECT query_id, candidate_key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_key) AS rank FROM (SELECT query_id, candidate_key, list_sum(list_sort(list(1.0::DOUBLE / (60 + route_rank)))) AS s FROM routed GROUP BY ALL) QUALIFY rank <= 20
), fresh AS (SELECT query_id, candidate_key, row_number() OVER (PARTITION BY query_id ORDER BY route_rank, candidate_key) AS gp FROM route r WHERE route_decision = 'selected' AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = r.query_id AND f.candidate_key = r.candidate_key) QUALIFY gp <= 4
), g AS (SELECT query_id, count(*) AS g FROM fresh GROUP BY query_id
), ex AS (SELECT f.query_id, candidate_key, 'baseline' AS origin, rank AS o FROM fused f LEFT JOIN g USING (query_id) WHERE rank <= 20 - coalesce(g, 0) UNION ALL SELECT query_id, candidate_key, 'graph', gp + 20 FROM fresh
), expanded AS MATERIALIZED (SELECT query_id, candidate_key, origin, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INTEGER) AS expanded_rank FROM ex)"""
GRAPH_EXPAND = "WITH " + _EXPAND + " SELECT * FROM expanded"


def _moved(spark: SparkSession, sf: str, expanded: DataFrame, selected: DataFrame) -> DataFrame:
    pool = expanded.withColumnRenamed("expanded_rank", "rank")
    types = V.query_constraints(spark, sf).groupBy("query_id").agg(F.count_distinct("ctype").alias("query_types"))
    paths = selected.join(types, "query_id").select("query_id", "candidate_key", G.path_score(F.col("tier"), F.col("type_count"), F.col("content_type_count"), F.col("query_types"), F.col("route_rank")).alias("path_score"))
    return G.shift_ranks(pool.join(paths, ["query_id", "candidate_key"], "left"), 2.0)


def graph_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Expanded candidates moved by their path scores."""
    selected = _selected(spark, sf)
    out = _moved(spark, sf, _expanded(spark, sf, selected), selected)
    return out.select("query_id", "candidate_key", "origin", "rank", F.round("path_score", 6).alias("path_score"), "new_rank")


GRAPH_RERANK = "WITH " + _EXPAND + """, qt AS (SELECT query_id, count(DISTINCT ctype) AS n FROM qc GROUP BY query_id
), ps AS (SELECT query_id, candidate_key, round((CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.0 END + round(type_count / n, 12) + round(content_type_count / n, 12) + round(1.0::DOUBLE / route_rank, 12)) / 4, 12) AS p FROM route JOIN qt USING (query_id) WHERE route_decision = 'selected')
SELECT e.query_id, e.candidate_key, origin, expanded_rank AS rank, round(p, 6) AS path_score, CAST(row_number() OVER (PARTITION BY e.query_id ORDER BY expanded_rank - 2.0::DOUBLE * coalesce(p, 0), expanded_rank, e.candidate_key) AS INTEGER) AS new_rank
FROM expanded e LEFT JOIN ps ON ps.query_id = e.query_id AND ps.candidate_key = e.candidate_key"""


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    pool = _fused(spark, sf).select("query_id", "candidate_key", "rank", (1.0 / F.col("rank")).alias("relevance_score"), F.lit(0.5).alias("authority_weight"))
    return G.coverage_rerank(pool, V.query_constraints(spark, sf), V.constraints(spark, sf), {"dose": 2.0, "medication": 1.5})


def coverage_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _covered(spark, sf).select("query_id", "candidate_key", F.round("coverage", 6).alias("coverage"), "rerank_status", F.round("graph_score", 6).alias("graph_score"), "new_rank")


COVERAGE_RERANK = "WITH " + _EXPAND + """, aq AS (SELECT DISTINCT query_id, ctype, CASE ctype WHEN 'dose' THEN 2.0 WHEN 'medication' THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM qc
), t AS (SELECT query_id, sum(w) AS t FROM aq GROUP BY ALL
), h AS (SELECT DISTINCT owner_id AS candidate_key, ctype FROM cc
), cv AS (SELECT f.query_id, f.candidate_key, sum(w) AS c FROM fused f JOIN aq ON aq.query_id = f.query_id JOIN h ON h.candidate_key = f.candidate_key AND h.ctype = aq.ctype GROUP BY ALL
), p AS (SELECT f.query_id, f.candidate_key, f.rank, t, CASE WHEN coalesce(t, 0) > 0 THEN coalesce(c, 0) / t ELSE 0 END::DOUBLE AS coverage FROM fused f LEFT JOIN t ON t.query_id = f.query_id LEFT JOIN cv ON cv.query_id = f.query_id AND cv.candidate_key = f.candidate_key
), s AS (SELECT *, CASE WHEN t IS NULL THEN 'no_query_constraints' WHEN max(coverage) OVER (PARTITION BY query_id) <= 0 THEN 'no_coverage' ELSE 'applied' END AS rerank_status, round(0.65::DOUBLE / rank + 0.20::DOUBLE * 0.5 + 0.15::DOUBLE * coverage, 10) AS gs FROM p)
SELECT query_id, candidate_key, round(coverage, 6) AS coverage, rerank_status, round(gs, 6) AS graph_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_status = 'applied' THEN -gs ELSE 0 END, rank, candidate_key) AS INTEGER) AS new_rank FROM s"""


def _evidence_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, candidate_key, rank, scope, ctype, cvalue) of each query's first four fused candidates."""
    top = _fused(spark, sf).where("rank <= 4").select("query_id", "candidate_key", "rank")
    c = V.constraints(spark, sf).where("scope IN ('content', 'context')").withColumnRenamed("owner_id", "candidate_key")
    return top.join(c.select("candidate_key", "scope", "ctype", "cvalue"), "candidate_key")


_EVIDENCE = _EXPAND + """, ec AS MATERIALIZED (SELECT f.query_id, f.candidate_key, f.rank, c.scope, c.ctype, c.cvalue FROM fused f JOIN cons c ON c.owner_id = f.candidate_key AND c.scope IN ('content', 'context') WHERE f.rank <= 4)"""
_MATCH = "({a} = {b} OR ({t} = 'dose' AND replace({a}, '/day', '') = replace({b}, '/day', '')) OR ({t} = 'route' AND {a} = 'iv_unspecified' AND {b} = 'iv_infusion'))"
_m = _MATCH.format(t="q.ctype", a="q.cvalue", b="e.cvalue")
_c = f"(NOT {_m} AND NOT (q.ctype = 'route' AND q.cvalue LIKE 'iv%' AND e.cvalue LIKE 'iv%') AND q.ctype IN ('dose', 'frequency', 'route', 'evidence_scope'))"


def constraint_audit(spark: SparkSession, sf: str) -> DataFrame:
    return G.audit_constraints(V.query_constraints(spark, sf), _evidence_constraints(spark, sf).where("scope = 'content'"))


CONSTRAINT_AUDIT = "WITH " + _EVIDENCE + f""" SELECT q.query_id, q.ctype, q.cvalue, CASE max(CASE WHEN e.cvalue IS NULL THEN 0 WHEN {_m} THEN 2 WHEN {_c} THEN 1 ELSE 0 END) WHEN 2 THEN 'matched' WHEN 1 THEN 'conflict' ELSE 'unsupported' END AS status
FROM qc q LEFT JOIN (SELECT DISTINCT query_id, ctype, cvalue FROM ec WHERE scope = 'content') e ON e.query_id = q.query_id AND e.ctype = q.ctype GROUP BY ALL"""


def constraint_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    q, e = V.query_constraints(spark, sf), _evidence_constraints(spark, sf).where("scope = 'content'")
    return G.constraint_graph(q, e)[1].groupBy("query_id", "edge_type").agg(F.count("*").alias("edges"))


CONSTRAINT_GRAPH_EDGES = "WITH " + _EVIDENCE + f""", e AS (SELECT * FROM ec WHERE scope = 'content'), ed AS (
  SELECT DISTINCT query_id, '' AS s, ctype || ':' || cvalue AS t, 'REQUIRES' AS edge_type FROM qc
  UNION ALL SELECT DISTINCT q.query_id, candidate_key, q.ctype || ':' || q.cvalue, 'MATCHES_TYPE' FROM qc q JOIN e ON e.query_id = q.query_id AND e.ctype = q.ctype
  UNION ALL SELECT DISTINCT q.query_id, candidate_key, q.ctype || ':' || q.cvalue, 'MATCHES_VALUE' FROM qc q JOIN e ON e.query_id = q.query_id AND e.ctype = q.ctype WHERE {_m}
  UNION ALL SELECT DISTINCT q.query_id, candidate_key, q.ctype || ':' || q.cvalue, 'CONFLICTS' FROM qc q JOIN e ON e.query_id = q.query_id AND e.ctype = q.ctype WHERE {_c})
SELECT query_id, edge_type, count(*) AS edges FROM ed GROUP BY ALL"""


def graph_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by kind of the built graph, from which evidence is taken away and to which copies are added by query."""
    q, e = V.query_constraints(spark, sf), _evidence_constraints(spark, sf).where("scope = 'content'")
    nodes, edges = G.constraint_graph(q, e.join(q.select("query_id").distinct(), "query_id", "left_semi"))
    k = F.col("query_id") % 5
    nodes = nodes.where((k != 0) | (F.col("node_type") != "evidence")).unionByName(nodes.where((k == 1) & (F.col("node_type") == "query")))
    nodes = nodes.unionByName(q.where(k == 2).select("query_id", F.lit("evidence:none").alias("node_id"), F.lit("evidence").alias("node_type")).distinct())
    edges = edges.unionByName(edges.where((k == 3) & (F.col("edge_type") == "REQUIRES"))).unionByName(edges.where((k == 4) & (F.col("edge_type") == "REQUIRES")).withColumn("edge_type", F.lit("WANTS")))
    return G.graph_violations(nodes, edges).groupBy("violation").agg(F.count("*").alias("n"))


GRAPH_CONTRACT_VIOLATIONS = "WITH " + _EVIDENCE + """, v AS (
  SELECT 'missing_endpoint' AS violation, count(*) AS n FROM (SELECT DISTINCT q.query_id, candidate_key FROM qc q JOIN ec e ON e.query_id = q.query_id AND e.ctype = q.ctype AND e.scope = 'content' WHERE q.query_id % 5 = 0)
  UNION ALL SELECT 'duplicate_node', count(DISTINCT query_id) FROM qc WHERE query_id % 5 = 1 UNION ALL SELECT 'root_count', count(DISTINCT query_id) FROM qc WHERE query_id % 5 = 1
  UNION ALL SELECT 'loose_node', (SELECT count(DISTINCT query_id) FROM qc WHERE query_id % 5 = 2) + (SELECT count(*) FROM (SELECT DISTINCT query_id, candidate_key FROM ec WHERE scope = 'content' AND query_id % 5 <> 0 AND query_id IN (SELECT query_id FROM qc) EXCEPT SELECT DISTINCT q.query_id, candidate_key FROM qc q JOIN ec e ON e.query_id = q.query_id AND e.ctype = q.ctype AND e.scope = 'content'))
  UNION ALL SELECT 'duplicate_edge', count(*) FROM (SELECT DISTINCT query_id, ctype, cvalue FROM qc WHERE query_id % 5 = 3) UNION ALL SELECT 'unknown_edge_type', count(*) FROM (SELECT DISTINCT query_id, ctype, cvalue FROM qc WHERE query_id % 5 = 4))
SELECT * FROM v WHERE n > 0"""


def consistency_labels(spark: SparkSession, sf: str) -> DataFrame:
    return G.compare_query_to_evidence(V.query_constraints(spark, sf), _evidence_constraints(spark, sf), EXCLUSIVE, HIGH_RISK, CONTEXT)


_LABELS = _EVIDENCE + """, qs AS (SELECT query_id, ctype, list(DISTINCT cvalue) AS a FROM qc GROUP BY ALL
), labels AS MATERIALIZED (
  SELECT qs.query_id, qs.ctype, len(list_intersect(a, coalesce(c, []))) > 0 AS supported_match,
    qs.ctype IN ('dose', 'frequency', 'route') AND len(coalesce(c, [])) = 1 AND len(list_intersect(a, coalesce(c, []))) = 0 AS corrective_value_mismatch,
    qs.ctype IN ('dose', 'medication') AND len(coalesce(c, [])) = 0 AS coverage_gap,
    qs.ctype IN ('age_group', 'clinical_condition') AND len(coalesce(x, [])) > 0 AND len(list_intersect(a, coalesce(x, []))) = 0 AS scope_mismatch
  FROM qs LEFT JOIN (SELECT query_id, ctype, list(DISTINCT cvalue) AS c FROM ec WHERE scope = 'content' GROUP BY ALL) cs ON cs.query_id = qs.query_id AND cs.ctype = qs.ctype
  LEFT JOIN (SELECT query_id, ctype, list(DISTINCT cvalue) AS x FROM ec WHERE scope = 'context' GROUP BY ALL) xs ON xs.query_id = qs.query_id AND xs.ctype = qs.ctype
)"""
CONSISTENCY_LABELS = "WITH " + _LABELS + " SELECT * FROM labels"


def evidence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence_constraints(spark, sf)
    ranks = _fused(spark, sf).where("rank <= 4").select("query_id", "candidate_key", "rank")
    return G.compare_evidence_pairs(e, ranks, EXCLUSIVE, ANCHORS, CONTEXT)


_PAIRS = _LABELS + """, ss AS (SELECT query_id, candidate_key, scope, ctype, list(DISTINCT cvalue) AS v FROM ec GROUP BY ALL
), pr AS (SELECT a.query_id, a.candidate_key AS a, b.candidate_key AS b FROM fused a JOIN fused b ON a.query_id = b.query_id AND a.rank < b.rank WHERE b.rank <= 4
), fl AS (
  SELECT pr.query_id, pr.a, pr.b, coalesce(bool_or(l.scope = 'context' AND l.ctype IN ('clinical_condition', 'medication') AND hit), false) AS anc, coalesce(bool_or(l.scope = 'context' AND l.ctype IN ('age_group', 'clinical_condition') AND hit), false) AS sh,
    coalesce(bool_or(l.scope = 'context' AND l.ctype IN ('age_group', 'clinical_condition') AND NOT hit), false) AS ap, coalesce(bool_or(l.scope = 'content' AND l.ctype IN ('dose', 'frequency', 'route') AND NOT hit), false) AS df
  FROM pr LEFT JOIN (SELECT l.query_id, l.candidate_key AS a, r.candidate_key AS b, l.scope, l.ctype, len(list_intersect(l.v, r.v)) > 0 AS hit FROM ss l JOIN ss r ON l.query_id = r.query_id AND l.scope = r.scope AND l.ctype = r.ctype) l ON l.query_id = pr.query_id AND l.a = pr.a AND l.b = pr.b GROUP BY ALL
), pairs AS MATERIALIZED (SELECT query_id, a AS left_key, b AS right_key, anc AND NOT ap AND sh AS comparable, CASE WHEN NOT (anc AND NOT ap AND sh) THEN 'not_comparable' WHEN df THEN 'evidence_evidence_conflict' ELSE '' END AS label FROM fl)"""
EVIDENCE_PAIRS = "WITH " + _PAIRS + " SELECT * FROM pairs"


def route_actions(spark: SparkSession, sf: str) -> DataFrame:
    names = ("supported_match", "corrective_value_mismatch", "coverage_gap", "scope_mismatch")
    labels = consistency_labels(spark, sf).groupBy("query_id").agg(*[F.bool_or(n).alias(n) for n in names])
    conflict = evidence_pairs(spark, sf).groupBy("query_id").agg(F.bool_or(F.col("label") == "evidence_evidence_conflict").alias("conflict"))
    df = V.questions(spark, sf).select("query_id").join(labels, "query_id", "left").join(conflict, "query_id", "left").na.fill(False)
    action = G.route_action(F.lit(False), F.col("conflict"), F.col("scope_mismatch"), F.col("coverage_gap"), F.col("corrective_value_mismatch"), F.col("supported_match"))
    return df.select("query_id", action.alias("route_action"))


ROUTE_ACTIONS = "WITH " + _PAIRS + """, l AS (SELECT query_id, bool_or(supported_match) AS s, bool_or(corrective_value_mismatch) AS c, bool_or(coverage_gap) AS g, bool_or(scope_mismatch) AS m FROM labels GROUP BY ALL
), p AS (SELECT query_id, bool_or(label = 'evidence_evidence_conflict') AS k FROM pairs GROUP BY ALL)
SELECT query_id, CASE WHEN coalesce(k, false) OR coalesce(m, false) THEN 'review_required' WHEN coalesce(g, false) THEN 'insufficient_evidence' WHEN coalesce(c, false) THEN 'allow_corrective_answer' WHEN coalesce(s, false) THEN 'allow_supported_answer' ELSE 'insufficient_evidence' END AS route_action
FROM questions LEFT JOIN l USING (query_id) LEFT JOIN p USING (query_id)"""


def claim_split(spark: SparkSession, sf: str) -> DataFrame:
    """Atomic claims of all assistant turns, with the stance of each."""
    t = V.table(spark, sf, "conversations").where("role = 'assistant'")
    c = t.select("conv_id", "turn", F.posexplode(split_claims("text")).alias("n", "claim"))
    return c.select("conv_id", "turn", (F.col("n") + 1).alias("claim_no"), F.length("claim").alias("chars"), stance(F.col("claim")).alias("stance"))


CLAIM_SPLIT = r"""WITH c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？!?；;\n]+'), lambda p: regexp_replace(p, '^[ ，,]+|[ ，,]+$', '', 'g')), lambda p: p <> '') AS l FROM conversations WHERE role = 'assistant'
), u AS (SELECT conv_id, turn, unnest(l) AS claim, unnest(range(1, len(l) + 1)) AS claim_no FROM c)
SELECT conv_id, turn, CAST(claim_no AS INTEGER) AS claim_no, CAST(length(claim) AS INTEGER) AS chars, CASE WHEN regexp_matches(claim, '""" + REJECTION + """') THEN 'reject' ELSE 'assert' END AS stance FROM u"""


def claim_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as answers, their claims' lexicon constraints against those of the conversation's user turns."""
    from evidrill.functions.constraints import lexicon_constraints

    t = V.table(spark, sf, "conversations").select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    sentences = t.where("role = 'assistant'").select("conv_id", F.explode(F.split("text", r"[!?\n]+")).alias("text")).where("trim(text) <> ''")
    claims = sentences.select(F.col("conv_id").cast("string").alias("answer_id"), F.sha2("text", 256).alias("claim_id"), "text").distinct()
    found = lexicon_constraints(claims.select(F.concat_ws("/", "answer_id", "claim_id").alias("owner_id"), F.lit("claim").alias("scope"), "text"), V.LEXICON)
    parts = F.split("owner_id", "/")
    own = found.select(parts[0].alias("answer_id"), parts[1].alias("claim_id"), "ctype", "cvalue").distinct()
    rows = claims.join(own, ["answer_id", "claim_id"], "left").withColumn("stance", stance(local_clause(F.col("text"), F.col("cvalue"))))
    e = lexicon_constraints(t.where("role = 'user'").select(F.col("conv_id").cast("string").alias("owner_id"), F.lit("content").alias("scope"), "text"), V.LEXICON)
    states = G.align_claims(rows.select("answer_id", "claim_id", "ctype", "cvalue", "stance"), e.select(F.col("owner_id").alias("answer_id"), "ctype", "cvalue"))
    return G.overall_state(states).select(F.col("answer_id").cast("long").alias("conv_id"), "claims", *G.CLAIM_STATES, "overall_state", "coverage_ratio", "requires_review")


CLAIM_ALIGNMENT = "WITH " + V.lexicon_values() + """, t AS (SELECT conv_id, role, coalesce(text, '') AS text FROM conversations
), cl AS (SELECT DISTINCT conv_id, c FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[!?\\n]+')) AS c FROM t WHERE role = 'assistant') WHERE trim(c) <> ''
), k AS (SELECT DISTINCT conv_id, c, ctype, cvalue FROM (SELECT conv_id, c, unnest(regexp_extract_all(lower(c), '[a-z0-9]+')) AS w FROM cl) JOIN lex ON w = alias
), ev AS (SELECT DISTINCT conv_id, ctype, cvalue FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t WHERE role = 'user') JOIN lex ON w = alias
), q AS (SELECT cl.conv_id, cl.c, k.ctype, k.cvalue FROM cl LEFT JOIN k ON k.conv_id = cl.conv_id AND k.c = cl.c
), s AS (SELECT q.conv_id, q.c, q.ctype, q.cvalue, coalesce(bool_or(""" + _m + """), false) AS m, coalesce(bool_or(NOT """ + _m + """ AND NOT (q.ctype = 'route' AND q.cvalue LIKE 'iv%' AND e.cvalue LIKE 'iv%') AND q.ctype IN ('dose', 'frequency', 'route', 'evidence_scope')), false) AS x FROM q LEFT JOIN ev e ON e.conv_id = q.conv_id AND e.ctype = q.ctype GROUP BY ALL
), w AS (SELECT conv_id, c, min(CASE WHEN ctype IS NULL THEN 2 WHEN m THEN 3 WHEN x THEN 0 ELSE 1 END) AS s FROM s GROUP BY ALL)
SELECT conv_id, count(*) AS claims, count(*) FILTER (s = 0) AS contradicted, count(*) FILTER (s = 1) AS unsupported, count(*) FILTER (s = 2) AS insufficient_evidence, count(*) FILTER (s = 3) AS supported,
  CASE min(s) WHEN 0 THEN 'contradicted' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'insufficient_evidence' ELSE 'supported' END AS overall_state, round(count(*) FILTER (s = 3) / count(*), 6) AS coverage_ratio, min(s) <= 1 AS requires_review FROM w GROUP BY conv_id"""

QUERIES = {
    "constraint_extract": (constraint_extract, CONSTRAINT_EXTRACT),
    "lexicon_constraints": (lexicon_constraints, LEXICON_CONSTRAINTS),
    "constraint_postings": (constraint_postings, CONSTRAINT_POSTINGS),
    "adjacent_pages": (adjacent_pages, ADJACENT_PAGES),
    "posting_ranking": (posting_ranking, POSTING_RANKING),
    "path_qualify": (path_qualify, PATH_QUALIFY),
    "path_route_quota": (path_route_quota, PATH_ROUTE_QUOTA),
    "graph_expand": (graph_expand, GRAPH_EXPAND),
    "graph_rerank": (graph_rerank, GRAPH_RERANK),
    "coverage_rerank": (coverage_rerank, COVERAGE_RERANK),
    "constraint_audit": (constraint_audit, CONSTRAINT_AUDIT),
    "constraint_graph_edges": (constraint_graph_edges, CONSTRAINT_GRAPH_EDGES),
    "graph_contract_violations": (graph_contract_violations, GRAPH_CONTRACT_VIOLATIONS),
    "consistency_labels": (consistency_labels, CONSISTENCY_LABELS),
    "evidence_pairs": (evidence_pairs, EVIDENCE_PAIRS),
    "route_actions": (route_actions, ROUTE_ACTIONS),
    "claim_split": (claim_split, CLAIM_SPLIT),
    "claim_alignment": (claim_alignment, CLAIM_ALIGNMENT),
}
