"""Evaluation queries: gold hits, curves, pairs, failures, redundancy, distributions, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.operators import evaluation as E
from evidrill.operators import retrieval as R
from evidrill.queries import views as V
from evidrill.queries.retrieval import _GRAMS, _NORM

_6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = E.retrieval_metrics(V.routed(spark, sf), V.gold(spark, sf))
    return m.select("query_id", "method_id", "source_hit", "strict_hit", "adjacent_hit", *_6("mrr", "source_precision", "page_precision"), "failure_type")


_METRICS = V.ROUTED + """, hits AS (
  SELECT g.query_id, r.method_id, min(CASE WHEN own THEN rank END) AS sr, min(CASE WHEN own AND d = 0 THEN rank END) AS pr, min(CASE WHEN own AND d <= 1 THEN rank END) AS ar,
         count(*) AS n, count(*) FILTER (own) AS sh, count(*) FILTER (own AND d = 0) AS ph
  FROM (SELECT r.*, lower(replace(r.source_file, ' ', '')) = lower(replace(g.source_file, ' ', '')) AS own, abs(r.page_number - g.page_number) AS d FROM routed r JOIN gold g USING (query_id)) r JOIN gold g USING (query_id)
  GROUP BY ALL
), metrics AS MATERIALIZED (
  SELECT g.query_id, m.method_id, CAST(sr IS NOT NULL AS INTEGER) AS source_hit, CAST(pr IS NOT NULL AS INTEGER) AS strict_hit, CAST(ar IS NOT NULL AS INTEGER) AS adjacent_hit,
         coalesce(1.0::DOUBLE / pr, 0) AS mrr, CASE WHEN n > 0 THEN sh / n ELSE 0 END::DOUBLE AS source_precision, CASE WHEN n > 0 THEN ph / n ELSE 0 END::DOUBLE AS page_precision,
         CASE WHEN coalesce(n, 0) = 0 THEN 'no_evidence' WHEN pr IS NOT NULL THEN 'gold_source_page_hit' WHEN ar IS NOT NULL THEN 'adjacent_page_only' WHEN sr IS NOT NULL THEN 'wrong_page_same_source' ELSE 'gold_source_absent' END AS failure_type
  FROM gold g CROSS JOIN (SELECT DISTINCT method_id FROM routed) m LEFT JOIN hits h ON h.query_id = g.query_id AND h.method_id = m.method_id
)"""
RETRIEVAL_METRICS = "WITH " + _METRICS + " SELECT query_id, method_id, source_hit, strict_hit, adjacent_hit, round(mrr, 6) AS mrr, round(source_precision, 6) AS source_precision, round(page_precision, 6) AS page_precision, failure_type FROM metrics"


def method_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = E.method_summary(E.retrieval_metrics(V.routed(spark, sf), V.gold(spark, sf)))
    return s.select("method_id", "queries", *_6("source_hit", "strict_hit", "adjacent_hit", "mrr", "source_precision", "page_precision"))


METHOD_SUMMARY = "WITH " + _METRICS + " SELECT method_id, count(*) AS queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("source_hit", "strict_hit", "adjacent_hit", "mrr", "source_precision", "page_precision")) + " FROM metrics GROUP BY method_id"


def paired_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired_counts(E.retrieval_metrics(V.routed(spark, sf), V.gold(spark, sf)), "dense", "sparse")


PAIRED_COUNTS = "WITH " + _METRICS + """ SELECT count(*) FILTER (d = 0 AND s = 1) AS added, count(*) FILTER (d = 1 AND s = 0) AS lost, count(*) FILTER (d = 1 AND s = 1) AS both, count(*) FILTER (d = 0 AND s = 0) AS neither
FROM (SELECT query_id, max(strict_hit) FILTER (method_id = 'dense') AS d, max(strict_hit) FILTER (method_id = 'sparse') AS s FROM metrics GROUP BY query_id)"""


def freeze_rule(spark: SparkSession, sf: str) -> DataFrame:
    s = E.method_summary(E.retrieval_metrics(V.routed(spark, sf), V.gold(spark, sf)))
    g = s.agg(F.max(F.when(F.col("method_id") == "sparse", F.col("strict_hit"))).alias("a"), F.max(F.when(F.col("method_id") == "dense", F.col("strict_hit"))).alias("b"), F.max(F.when(F.col("method_id") == "sparse", F.col("source_hit"))).alias("c"), F.max(F.when(F.col("method_id") == "dense", F.col("source_hit"))).alias("d"))
    return g.select(E.freeze_candidate(F.col("a") - F.col("b"), F.col("c") - F.col("d")).alias("freeze"))


FREEZE_RULE = "WITH " + _METRICS + " SELECT avg(strict_hit) FILTER (method_id = 'sparse') - avg(strict_hit) FILTER (method_id = 'dense') > 0 AND avg(source_hit) FILTER (method_id = 'sparse') - avg(source_hit) FILTER (method_id = 'dense') >= 0 AS freeze FROM metrics"


def budget_curve(spark: SparkSession, sf: str) -> DataFrame:
    fused = R.budget_fusion(V.routed(spark, sf), (5, 10, 20)).withColumn("method_id", F.lit("rrf"))
    ranked = fused.join(V.chunks(spark, sf).select("candidate_key", "source_file", "page_number"), "candidate_key")
    c = E.budget_curve(ranked, V.gold(spark, sf), (5, 10, 20))
    return c.select("method_id", "budget", "queries", "strict_hits", *_6("strict_recall", "mrr"), "new_hits")


BUDGET_CURVE = "WITH " + V.ROUTED + """, b AS (SELECT unnest([5, 10, 20]) AS budget
), f AS (
  SELECT budget, query_id, candidate_key, CAST(row_number() OVER (PARTITION BY budget, query_id ORDER BY s DESC, candidate_key) AS INTEGER) AS rank FROM (
    SELECT budget, query_id, candidate_key, list_sum(list_sort(list(1.0::DOUBLE / (60 + route_rank)))) AS s FROM routed JOIN b ON route_rank <= budget GROUP BY ALL)
  QUALIFY rank <= budget
), h AS (
  SELECT g.query_id, b.budget, min(f.rank) AS sr FROM gold g CROSS JOIN b LEFT JOIN (f JOIN chunks c USING (candidate_key)) ON f.query_id = g.query_id AND f.budget = b.budget AND lower(c.source_file) = lower(g.source_file) AND c.page_number = g.page_number GROUP BY ALL
), k AS (SELECT *, min(CASE WHEN sr IS NOT NULL THEN budget END) OVER (PARTITION BY query_id) AS fb FROM h)
SELECT 'rrf' AS method_id, budget, count(*) AS queries, count(sr) AS strict_hits, round(avg(CAST(sr IS NOT NULL AS INTEGER)), 6) AS strict_recall, round(avg(coalesce(1.0::DOUBLE / sr, 0)), 6) AS mrr, count(*) FILTER (fb = budget) AS new_hits FROM k GROUP BY budget"""


def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf)
    fused = R.rrf(r, 60, 10).join(V.chunks(spark, sf).select("candidate_key", "source_file", "page_number"), "candidate_key").withColumn("method_id", F.lit("rrf"))
    names = ["query_id", "method_id", "source_file", "page_number"]
    return E.failure_taxonomy(r.select(*names).unionByName(fused.select(*names)), V.gold(spark, sf))


FAILURE_TAXONOMY = "WITH " + V.ROUTED + """, fused AS (
  SELECT query_id, candidate_key FROM (SELECT query_id, candidate_key, list_sum(list_sort(list(1.0::DOUBLE / (60 + route_rank)))) AS s FROM routed GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_key) <= 10
), a AS (
  SELECT query_id, method_id, source_file, page_number FROM routed UNION ALL SELECT query_id, 'rrf', source_file, page_number FROM fused JOIN chunks USING (candidate_key)
), f AS (
  SELECT g.query_id, coalesce(bool_or(own AND d = 0 AND method_id = 'rrf'), false) AS fu, coalesce(bool_or(own AND d = 0 AND method_id = 'dense'), false) AS de, coalesce(bool_or(own AND d = 0 AND method_id = 'sparse'), false) AS sp, coalesce(bool_or(own AND d = 1), false) AS ne, coalesce(bool_or(own), false) AS so
  FROM gold g LEFT JOIN (SELECT a.*, lower(a.source_file) = lower(g.source_file) AS own, abs(a.page_number - g.page_number) AS d FROM a JOIN gold g USING (query_id)) x USING (query_id) GROUP BY ALL
)
SELECT query_id, CASE WHEN fu THEN 'hit' WHEN de THEN 'fusion_dropped_valid_dense' WHEN sp THEN 'fusion_dropped_valid_sparse' WHEN ne THEN 'adjacent_page' WHEN so THEN 'wrong_page_same_source' ELSE 'source_absent' END AS failure FROM f"""


def route_union(spark: SparkSession, sf: str) -> DataFrame:
    return E.route_union(V.routed(spark, sf), ("dense", "sparse"))


ROUTE_UNION = "WITH " + V.ROUTED + """, u AS (
  SELECT query_id, candidate_key, string_agg(method_id, ',' ORDER BY method_id) AS routes, min((method_id, rank)) AS f FROM routed GROUP BY ALL)
SELECT query_id, candidate_key, routes, CASE WHEN contains(routes, 'dense') THEN 'dense' ELSE 'sparse' END AS first_route,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, candidate_key) AS INTEGER) AS union_rank FROM u"""


def source_page_agg(spark: SparkSession, sf: str) -> DataFrame:
    return E.source_pages(V.routed(spark, sf))


SOURCE_PAGE_AGG = "WITH " + V.ROUTED + """ SELECT query_id, method_id, source_file, page_number, arg_min(candidate_key, (rank, candidate_key)) AS candidate_key, min(rank) AS rank, count(*) AS members, string_agg(candidate_key, ',' ORDER BY rank, candidate_key) AS member_keys FROM routed GROUP BY ALL"""


def source_crowding(spark: SparkSession, sf: str) -> DataFrame:
    return E.source_crowding(V.routed(spark, sf)).select("query_id", "method_id", "unique_sources", "max_per_source", *_6("max_share"))


SOURCE_CROWDING = "WITH " + V.ROUTED + " SELECT query_id, method_id, count(*) AS unique_sources, max(n) AS max_per_source, round(max(n) / sum(n), 6) AS max_share FROM (SELECT query_id, method_id, source_file, count(*) AS n FROM routed GROUP BY ALL) GROUP BY ALL"


def redundancy(spark: SparkSession, sf: str) -> DataFrame:
    return E.redundancy(V.evidence(spark, sf), 0.5)


_REDUNDANCY = V.ROUTED + f""", t AS (SELECT query_id, method_id, rank, {_NORM.format('content')} AS t FROM routed JOIN (SELECT candidate_key, content FROM chunks) USING (candidate_key) WHERE rank <= 4
), g AS (SELECT query_id, method_id, rank, {_GRAMS.format('t')} AS g FROM t
), p AS (SELECT a.query_id, a.method_id, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.query_id = b.query_id AND a.method_id = b.method_id AND a.rank < b.rank
), r AS (SELECT query_id, method_id, CAST(count(*) AS INTEGER) AS pairs, CAST(count(*) FILTER (s > i AND i >= 0.5 * (s - i)) AS INTEGER) AS redundant_pairs FROM p GROUP BY ALL)"""
REDUNDANCY = "WITH " + _REDUNDANCY + " SELECT * FROM r"


def redundancy_rates(spark: SparkSession, sf: str) -> DataFrame:
    return E.redundancy_rates(E.redundancy(V.evidence(spark, sf), 0.5)).select("method_id", *_6("ratio_of_sums", "mean_of_ratios"))


REDUNDANCY_RATES = "WITH " + _REDUNDANCY + " SELECT method_id, round(sum(redundant_pairs) / sum(pairs), 6) AS ratio_of_sums, round(avg(redundant_pairs / pairs), 6) AS mean_of_ratios FROM r GROUP BY method_id"


def anchor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return E.anchor_coverage(V.evidence(spark, sf), V.gold(spark, sf)).select("query_id", "method_id", *_6("coverage"))


ANCHOR_COVERAGE = "WITH " + V.ROUTED + f""", t AS (SELECT r.query_id, method_id, {_NORM.format('content')} AS t, {_NORM.format('anchor_text_span')} AS a FROM routed r JOIN (SELECT candidate_key, content FROM chunks) USING (candidate_key) JOIN (SELECT query_id, anchor_text_span FROM gold) USING (query_id) WHERE rank <= 4
), g AS (SELECT query_id, method_id, {_GRAMS.format('t')} AS g, {_GRAMS.format('a')} AS a FROM t)
SELECT query_id, method_id, round(max(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, g)) / len(a) END), 6) AS coverage FROM g GROUP BY ALL"""


def change_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf).where("rank <= 4")
    return E.change_audit(r.where("method_id = 'dense'"), r.where("method_id = 'sparse'"))


CHANGE_AUDIT = "WITH " + V.ROUTED + """, c AS (
  SELECT coalesce(b.query_id, a.query_id) AS query_id, b.rank AS br, a.rank AS ar FROM (SELECT * FROM routed WHERE method_id = 'dense' AND rank <= 4) b FULL JOIN (SELECT * FROM routed WHERE method_id = 'sparse' AND rank <= 4) a ON a.query_id = b.query_id AND a.candidate_key = b.candidate_key
), g AS (SELECT query_id, count(*) FILTER (br IS NULL) AS added, count(*) FILTER (ar IS NULL) AS removed, count(*) FILTER (br <> ar) AS moved FROM c GROUP BY query_id)
SELECT *, CASE WHEN added + removed > 0 THEN 'membership' WHEN moved > 0 THEN 'order_only' ELSE 'unchanged' END AS change FROM g"""


def score_parity(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf)
    return E.score_parity(r.where("method_id = 'dense'"), r.where("method_id = 'sparse'"), ["query_id", "candidate_key"], "raw_score", 10.0)


SCORE_PARITY = "WITH " + V.ROUTED + " SELECT count(*) AS shared, quantile_cont(d, 0.5) AS median_diff, max(d) AS max_diff, count(*) FILTER (d > 10) AS over_tolerance FROM (SELECT abs(a.raw_score - b.raw_score) AS d FROM routed a JOIN routed b ON a.query_id = b.query_id AND a.candidate_key = b.candidate_key AND a.method_id = 'dense' AND b.method_id = 'sparse')"


def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = E.distribution(V.table(spark, sf, "events"), ["event_type"], "value")
    return d.select("event_type", "n_values", *_6("min", "median", "p95", "max", "mean"))


VALUE_DISTRIBUTION = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n_values, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(max(CASE WHEN rn = ceil(0.95::DOUBLE * n) THEN value END), 6) AS p95, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM r GROUP BY event_type"""


def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    calls = V.table(spark, sf, "events").select(F.col("event_type").alias("method_id"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), (F.col("user_id") % 7).alias("output_tokens"))
    return E.usage_totals(calls, 2.0, 8.0).select("method_id", "calls", "input_tokens", "output_tokens", *_6("cost"))


USAGE_TOTALS = """SELECT event_type AS method_id, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(user_id % 7) AS BIGINT) AS output_tokens,
round(round((sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) * 2.0::DOUBLE + sum(user_id % 7) * 8.0::DOUBLE) / 1e6, 8), 6) AS cost FROM events GROUP BY event_type"""


def rank_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    hits = E.first_hits(V.routed(spark, sf), V.gold(spark, sf))
    side = lambda m, c: hits.where(F.col("method_id") == m).select("query_id", F.col("strict_rank").alias(c))
    both = V.gold(spark, sf).select("query_id").join(side("dense", "b"), "query_id", "left").join(side("sparse", "a"), "query_id", "left")
    return both.groupBy(E.rank_outcome(F.col("b"), F.col("a")).alias("outcome")).agg(F.count("*").alias("n"))


RANK_OUTCOMES = "WITH " + V.ROUTED + """, h AS (SELECT g.query_id, min(r.rank) FILTER (method_id = 'dense') AS b, min(r.rank) FILTER (method_id = 'sparse') AS a FROM gold g LEFT JOIN routed r ON r.query_id = g.query_id AND lower(r.source_file) = lower(g.source_file) AND r.page_number = g.page_number GROUP BY ALL)
SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'not_applicable' WHEN b IS NULL OR a < b THEN 'improved' WHEN a IS NULL OR a > b THEN 'worsened' ELSE 'unchanged' END AS outcome, count(*) AS n FROM h GROUP BY 1"""

QUERIES = {
    "retrieval_metrics": (retrieval_metrics, RETRIEVAL_METRICS),
    "method_summary": (method_summary, METHOD_SUMMARY),
    "paired_counts": (paired_counts, PAIRED_COUNTS),
    "freeze_rule": (freeze_rule, FREEZE_RULE),
    "budget_curve": (budget_curve, BUDGET_CURVE),
    "failure_taxonomy": (failure_taxonomy, FAILURE_TAXONOMY),
    "route_union": (route_union, ROUTE_UNION),
    "source_page_agg": (source_page_agg, SOURCE_PAGE_AGG),
    "source_crowding": (source_crowding, SOURCE_CROWDING),
    "redundancy": (redundancy, REDUNDANCY),
    "redundancy_rates": (redundancy_rates, REDUNDANCY_RATES),
    "anchor_coverage": (anchor_coverage, ANCHOR_COVERAGE),
    "change_audit": (change_audit, CHANGE_AUDIT),
    "score_parity": (score_parity, SCORE_PARITY),
    "value_distribution": (value_distribution, VALUE_DISTRIBUTION),
    "usage_totals": (usage_totals, USAGE_TOTALS),
    "rank_outcomes": (rank_outcomes, RANK_OUTCOMES),
}
