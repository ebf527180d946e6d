"""Retrieval queries: routes, fusion, filters, dedup, trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions import rules, text
from evidrill.operators import retrieval as R
from evidrill.plans import service
from evidrill.queries import views as V
from evidrill.sources.scratch import write_once


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = R.dense_top_k(V.vectors(spark, sf), V.vector_queries(spark, sf), 5)
    return top.select("query_id", "collection", "candidate_key", F.round("distance", 6).alias("distance"), F.round("raw_score", 6).alias("raw_score"), "route_rank", "route")


DENSE_TOPK = "WITH " + V.DENSE + " SELECT query_id, collection, candidate_key, round(distance, 6) AS distance, round(1 - distance, 6) AS raw_score, route_rank, 'dense_exact:' || collection AS route FROM dense"


def trust_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest evidence over all collections, weighted by authority, through the trust gate."""
    top = R.ranked(R.dense_top_k(V.vectors(spark, sf), V.vector_queries(spark, sf), 5), ["query_id"], [F.col("distance"), F.col("candidate_key")], 2).where("rank = 2")
    weight = F.when(F.col("collection") == "128", 1.0).when(F.col("collection") == "512", 0.9).otherwise(0.7)
    relevance = 1 / (1 + F.col("distance"))
    score, level = R.trust_score(relevance * 10, F.lit(9.0), weight)
    return top.select("query_id", "candidate_key", F.round(relevance, 6).alias("relevance"), weight.alias("w_authority"), score.alias("trust_score"), level.alias("trust_level"))


TRUST_GATE = "WITH " + V.DENSE + """, t AS (
  SELECT query_id, candidate_key, 1 / (1 + distance) AS rel, CASE collection WHEN '128' THEN 1.0 WHEN '512' THEN 0.9 ELSE 0.7 END::DOUBLE AS w FROM dense
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, candidate_key) = 2
), s AS (SELECT *, round((0.4::DOUBLE * rel * 10 + 0.6::DOUBLE * 9) * w, 4) AS ts FROM t)
SELECT query_id, candidate_key, round(rel, 6) AS relevance, w AS w_authority, ts AS trust_score, CASE WHEN ts >= 7.5 THEN 'TRUSTED' WHEN ts > 5 THEN 'WARNING' ELSE 'REJECTED' END AS trust_level FROM s"""


def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    d, q = V.word_weights(spark, sf)
    return R.sparse_top_k(d, q, 20).select("query_id", "candidate_key", "raw_score", "route_rank")


SPARSE_TOPK = "WITH " + V.ROUTED + " SELECT query_id, candidate_key, raw_score, route_rank FROM routed WHERE method_id = 'sparse'"


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.rrf(V.routed(spark, sf), 60, 20).select("query_id", "candidate_key", F.round("rrf_score", 6).alias("rrf_score"), "n_routes", "rank")


_RRF = V.ROUTED + """, fused AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, candidate_key) AS INTEGER) AS frank FROM (
    SELECT query_id, candidate_key, list_sum(list_sort(list(1.0::DOUBLE / (60 + route_rank)))) AS rrf_score, CAST(count(*) AS INTEGER) AS n_routes FROM routed GROUP BY ALL)
  QUALIFY frank <= 20
)"""
RRF_FUSION = "WITH " + _RRF + " SELECT query_id, candidate_key, round(rrf_score, 6) AS rrf_score, n_routes, frank AS rank FROM fused"


def rrf_page_fusion(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf).withColumn("final_score", F.col("raw_score"))
    return R.rrf_pages(r, 60).select("query_id", "source_file", "page_number", F.round("rrf_score", 6).alias("rrf_score"), "members", "candidate_key", "rank")


RRF_PAGE_FUSION = "WITH " + V.ROUTED + """, p AS (
  SELECT query_id, source_file, page_number, list_sum(list_sort(list(1.0::DOUBLE / (60 + route_rank)))) AS s, count(*) AS members, max(raw_score) AS fs,
         arg_max(candidate_key, (raw_score, -route_rank, candidate_key)) AS candidate_key
  FROM routed GROUP BY ALL)
SELECT query_id, source_file, page_number, round(s, 6) AS rrf_score, members, candidate_key,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fs DESC, source_file, page_number) AS INTEGER) AS rank FROM p"""


def method_fusion(spark: SparkSession, sf: str) -> DataFrame:
    methods = {"dense_only": ["dense"], "sparse_only": ["sparse"], "hybrid": ["dense", "sparse"]}
    return R.fuse_methods(V.routed(spark, sf), methods).select("query_id", "method_id", "candidate_key", F.round("rrf_score", 6).alias("rrf_score"), "rank")


METHOD_FUSION = "WITH " + V.ROUTED + """, m AS (
  SELECT *, CASE method_id WHEN 'dense' THEN 'dense_only' ELSE 'sparse_only' END AS m FROM routed UNION ALL SELECT *, 'hybrid' FROM routed
), f AS (SELECT query_id, m, candidate_key, list_sum(list_sort(list(1.0::DOUBLE / (60 + route_rank)))) AS s FROM m GROUP BY ALL)
SELECT query_id, m AS method_id, candidate_key, round(s, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id, m ORDER BY s DESC, candidate_key) AS INTEGER) AS rank
FROM f QUALIFY rank <= 20"""


def rerank_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Fused candidates reordered by the offline lexical scorer."""
    pool = R.rrf(V.routed(spark, sf), 60, 20).join(V.chunks(spark, sf).select("candidate_key", "content"), "candidate_key").join(V.questions(spark, sf), "query_id")
    out = R.rerank(pool, R.lexical_scorer("query", "content"))
    return out.select("query_id", "candidate_key", F.round("rerank_score", 6).alias("rerank_score"), "pre_rerank_rank", "post_rerank_rank")


_NORM = "lower(regexp_replace({0}, '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'))"
# trigrams from three linear passes; a substring at every place would start over each time
_GRAMS = "CASE WHEN length({0}) = 0 THEN []::VARCHAR[] WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_concat(list_concat(regexp_extract_all({0}, '.{{3}}'), regexp_extract_all(substring({0}, 2), '.{{3}}')), regexp_extract_all(substring({0}, 3), '.{{3}}'))) END"
RERANK_RANKS = "WITH " + _RRF + f""", n AS (
  SELECT query_id, candidate_key, rrf_score, frank, {_NORM.format('query')} AS q, {_NORM.format('content')} AS c FROM fused JOIN chunks USING (candidate_key) JOIN questions USING (query_id)
), g AS (SELECT *, {_GRAMS.format('q')} AS a, {_GRAMS.format('c')} AS b FROM n
), s AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS score FROM g)
SELECT query_id, candidate_key, round(score, 6) AS rerank_score, frank AS pre_rerank_rank,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf_score DESC, candidate_key) AS INTEGER) AS post_rerank_rank FROM s"""


def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    pool = R.rrf(V.routed(spark, sf), 60, 20).select("query_id", "candidate_key", "rank")
    return R.greedy_dedup(pool, 0.75, texts=V.chunks(spark, sf)).select("query_id", "evidence_rank", "candidate_key", "seen", "invalid", "exact", "overlap")


GREEDY_DEDUP = "WITH RECURSIVE " + _RRF + f""", n AS (
  SELECT query_id, candidate_key AS k, CAST(frank AS INTEGER) AS o, source_file AS s, page_number AS p, {_NORM.format('content')} AS t, coalesce(trim(source_file), '') <> '' AND coalesce(page_number > 0, false) AS v FROM fused JOIN chunks USING (candidate_key)
), m AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM n b WHERE b.query_id = n.query_id AND b.k <> n.k AND b.s = n.s AND b.p = n.p) AS shared FROM n
), g AS MATERIALIZED (SELECT *, CASE WHEN shared THEN {_GRAMS.format('t')} ELSE [] END AS g, sha256(t) AS h FROM m
), r AS (
  SELECT DISTINCT query_id, 0 AS o, []::STRUCT(k VARCHAR, h VARCHAR, s VARCHAR, p INTEGER, g VARCHAR[])[] AS kept, 0 AS seen, 0 AS invalid, 0 AS exact, 0 AS overlap FROM g
  UNION ALL
  SELECT query_id, o, CASE WHEN full_ OR NOT v OR same OR close THEN kept ELSE list_append(kept, {{'k': k, 'h': h, 's': s, 'p': p, 'g': g}}) END, seen + (NOT full_)::INT, invalid + (NOT full_ AND NOT v)::INT, exact + (NOT full_ AND v AND same)::INT, overlap + (NOT full_ AND v AND NOT same AND close)::INT
  FROM (SELECT g.query_id, g.o, r.kept, r.seen, r.invalid, r.exact, r.overlap, g.v, g.k, g.h, g.s, CAST(g.p AS INTEGER) AS p, g.g, len(r.kept) >= 4 AS full_,
      len(list_filter(r.kept, lambda a: a.h = g.h)) > 0 AS same,
      len(list_filter(r.kept, lambda a: a.s = g.s AND a.p = g.p AND least(len(a.g), len(g.g)) > 0 AND len(list_intersect(a.g, g.g)) >= 0.75 * least(len(a.g), len(g.g)))) > 0 AS close
    FROM r JOIN g ON g.query_id = r.query_id AND g.o = r.o + 1)
), z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o DESC) = 1)
SELECT query_id, CASE WHEN len(kept) > 0 THEN i END AS evidence_rank, kept[i].k AS candidate_key, seen, invalid, exact, overlap FROM (SELECT *, CAST(unnest(range(1, greatest(len(kept), 1) + 1)) AS INTEGER) AS i FROM z)"""


def admit_evidence(spark: SparkSession, sf: str) -> DataFrame:
    pool = R.rrf(V.routed(spark, sf), 60, 20).join(V.chunks(spark, sf).select("candidate_key", "source_file", "page_number", "content"), "candidate_key")
    return R.admit_evidence(pool, 4).select("query_id", "candidate_key", "rank", "reason")


ADMIT_EVIDENCE = "WITH " + _RRF + f""", n AS (
  SELECT query_id, candidate_key, frank AS rank, {_NORM.format('content')} AS t, trim(source_file) = '' OR page_number <= 0 AS bad, lower(source_file) AS stem FROM fused JOIN chunks USING (candidate_key)
), a AS (SELECT *, CASE WHEN bad THEN 'invalid_provenance' WHEN t <> '' AND t = stem THEN 'title_only' END AS r0 FROM n
), b AS (SELECT *, coalesce(r0, CASE WHEN row_number() OVER (PARTITION BY query_id, t, r0 IS NULL ORDER BY rank) > 1 THEN 'duplicate' END) AS r1 FROM a)
SELECT query_id, candidate_key, rank, coalesce(r1, CASE WHEN sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) > 4 THEN 'over_limit' ELSE 'admitted' END) AS reason FROM b"""


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    e = V.routed(spark, sf).join(V.chunks(spark, sf).select("candidate_key", "content"), "candidate_key")
    return R.first_by_signature(e, [F.col("raw_score").desc(), F.col("route"), F.col("rank")]).select("query_id", "source_file", "page_number", "candidate_key", "route")


DEDUP_FIRST = "WITH " + V.ROUTED + """
SELECT query_id, source_file, page_number, candidate_key, route FROM (SELECT r.*, left(regexp_replace(content, '[ \\t\\n\\r\\f\\v]+', '', 'g'), 120) AS sig FROM routed r JOIN (SELECT candidate_key, content FROM chunks) USING (candidate_key))
QUALIFY row_number() OVER (PARTITION BY query_id, source_file, page_number, sig ORDER BY raw_score DESC, route, rank) = 1"""


def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    q = V.questions(spark, sf)
    return q.select("query_id", rules.expand_query("query", V.EXPANSIONS).alias("retrieval_text"), rules.is_broad_review("query").alias("broad_review"))


QUERY_EXPANSION = "WITH " + V.QUESTIONS + """, a AS (
  SELECT query_id, query, list_distinct(list_filter([CASE WHEN contains(query, 'with') OR contains(query, 'avec') THEN 'alpha beta' END, CASE WHEN contains(query, 'under') OR contains(query, 'nicht') THEN 'gamma' END, CASE WHEN contains(query, 'this') THEN 'alpha beta' END], lambda x: x IS NOT NULL)) AS l FROM questions)
SELECT query_id, CASE WHEN len(l) = 0 THEN query ELSE query || ' ' || array_to_string(list_sort(l), ' ') END AS retrieval_text, false AS broad_review FROM a"""


def authority_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf)
    g = c.groupBy("source_file").agg(F.count("*").alias("chunks"))
    return g.select("source_file", "chunks", rules.authority_level("source_file", V.AUTHORITY).alias("level"), rules.authority_weight("source_file", V.AUTHORITY).alias("weight"))


AUTHORITY_WEIGHTS = "WITH " + V.CHUNKS + """
SELECT source_file, count(*) AS chunks, CASE WHEN contains(source_file, 'src1') THEN 'clinical_guideline' WHEN contains(source_file, 'src2') THEN 'expert_consensus' WHEN contains(source_file, 'src0') THEN 'national_pharmacopoeia' ELSE 'default' END AS level,
       CASE WHEN contains(source_file, 'src1') THEN 0.9 WHEN contains(source_file, 'src2') THEN 0.7 WHEN contains(source_file, 'src0') THEN 1.0 ELSE 0.5 END::DOUBLE AS weight
FROM chunks GROUP BY source_file"""


def noise_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf)
    return c.select("doc_id", rules.is_noise("content").alias("noise"), rules.is_title_only("content").alias("title_only"))


NOISE_CHUNKS = "WITH " + V.CHUNKS + r""", l AS (
  SELECT doc_id, content, list_transform(list_filter(regexp_split_to_array(content, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), lambda x: trim(x) <> ''), lambda x: trim(trim(trim(x), '#'))) AS ls FROM chunks
), t AS (SELECT *, regexp_replace(array_to_string(ls, ''), '[ \t\n\r\f\v#\x{3000}，。、《》（）()：:;；·.\-]+', '', 'g') AS k, regexp_matches(content, '治疗|评估|推荐|剂量|疗程|用药|抗生素|症状|检查|预防|接种|免疫|住院|重症|病原体|疗效|给药|静脉|口服|qd|bid|mg') AS signal FROM l
), r AS (SELECT doc_id, content, len(ls) = 0 OR k = '' OR (length(k) < 28 AND NOT signal) AS title_only FROM t)
SELECT doc_id, title_only OR content = '' AS noise, title_only FROM r"""


def neighbour_pages(spark: SparkSession, sf: str) -> DataFrame:
    seeds = V.routed(spark, sf).where("method_id = 'sparse' AND rank <= 4").select("query_id", "source_file", "page_number", F.col("rank").alias("seed_rank"))
    pages = V.chunks(spark, sf).select("source_file", "page_number", "candidate_key")
    return R.neighbour_pages(seeds, pages, 1).select("query_id", "source_file", "page_number", "candidate_key", "seed_rank", "offset")


NEIGHBOUR_PAGES = "WITH " + V.ROUTED + """, s AS (SELECT query_id, source_file, page_number, rank AS seed_rank FROM routed WHERE method_id = 'sparse' AND rank <= 4)
SELECT s.query_id, c.source_file, c.page_number, c.candidate_key, s.seed_rank, CAST(c.page_number - s.page_number AS INTEGER) AS "offset"
FROM s JOIN chunks c ON c.source_file = s.source_file AND abs(c.page_number - s.page_number) = 1
WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = s.query_id AND z.source_file = c.source_file AND z.page_number = c.page_number)
QUALIFY row_number() OVER (PARTITION BY s.query_id, c.source_file, c.page_number ORDER BY s.seed_rank, c.page_number - s.page_number, c.candidate_key) = 1"""


def physical_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Logical retrievals and the distinct physical ones that serve them."""
    tasks = V.table(spark, sf, "events").select(F.col("user_id"), F.col("event_type"), F.to_date("ts").cast("string").alias("day"))
    keyed = R.distinct_profiles(tasks, ["event_type", "day"])
    return keyed.groupBy("physical_key").agg(F.count("*").alias("logical_tasks"), F.count_distinct("user_id").alias("users"))


PHYSICAL_DEDUP = "SELECT sha256(event_type || '|' || strftime(ts, '%Y-%m-%d')) AS physical_key, count(*) AS logical_tasks, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def evidence_snippets(spark: SparkSession, sf: str) -> DataFrame:
    e = V.evidence(spark, sf).where("method_id = 'sparse'")
    return R.evidence_snippets(e, 3, 80, "rank").select("query_id", "candidate_key", "rank", "snippet")


EVIDENCE_SNIPPETS = "WITH " + V.ROUTED + """
SELECT query_id, candidate_key, rank, snippet FROM (SELECT r.query_id, r.candidate_key, r.rank, left(trim(regexp_replace(content, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 80) AS snippet FROM routed r JOIN (SELECT candidate_key, content FROM chunks) USING (candidate_key) WHERE method_id = 'sparse' AND rank <= 3) WHERE snippet <> ''"""


def char_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = V.evidence(spark, sf).where("method_id = 'dense'").join(V.questions(spark, sf), "query_id")
    return e.select("query_id", "candidate_key", F.round(text.question_char_overlap("query", "content"), 6).alias("overlap"))


_CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda x: x <> ''))"
CHAR_OVERLAP = "WITH " + V.ROUTED + f""", n AS (SELECT r.query_id, r.candidate_key, {_NORM.format('query')} AS q, {_NORM.format('content')} AS c FROM routed r JOIN (SELECT candidate_key, content FROM chunks) USING (candidate_key) JOIN questions USING (query_id) WHERE method_id = 'dense' AND rank <= 4)
SELECT query_id, candidate_key, round(CASE WHEN q = '' THEN 0.0 ELSE len(list_intersect({_CHARS.format('q')}, {_CHARS.format('c')})) / len({_CHARS.format('q')}) END, 6) AS overlap FROM n"""

#: Questions that the service's own rules answer, beside the benchmark's.
SERVICE_QUESTIONS = ((-1, "孩子发热，布洛芬可以同时使用吗"), (-2, "咳嗽有痰用什么止咳"), (-3, "阿奇霉素 每日两次"))
#: What some documents say besides, so that the rules find their words: (remainder of the id by eight, source, text).
SERVICE_SOURCES = ((1, "NICE_NG143_Fever_in_under_5s.pdf", " paracetamol or ibuprofen for fever in distress"), (2, "NICE_NG120_Acute_cough_antimicrobial_prescribing.pdf", " acute cough: honey and self-care"), (3, "国家基本药物目录（2018年版）.pdf", " 阿奇霉素 qd 口服"))


def _service(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors and granularities, and questions with the vector of the document of their number."""
    c = V.vectors(spark, sf).join(V.chunks(spark, sf).drop("candidate_key"), F.col("vec_id") == F.col("doc_id"))
    k = F.col("doc_id") % 8
    source, text = F.col("source_file"), F.col("content")
    for at, name, words in SERVICE_SOURCES:
        source, text = F.when(k == at, F.lit(name)).otherwise(source), F.when(k == at, F.concat(text, F.lit(words))).otherwise(text)
    c = c.select("candidate_key", F.col("collection").cast("int").alias("granularity"), source.alias("source_file"), "page_number", F.when(F.contains("content", F.lit(" | ")), "table").otherwise("text").alias("block_type"), text.alias("content"), "embedding")
    q = V.questions(spark, sf).unionByName(spark.createDataFrame(list(SERVICE_QUESTIONS), "query_id long, query string"))
    v = V.table(spark, sf, "embeddings").select((F.col("vec_id") - len(SERVICE_QUESTIONS)).alias("query_id"), F.col("embedding").alias("query_vector"))
    return c, q.join(v, "query_id")


def service_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The online service over all questions: routes, fallbacks, weights, boosts, required terms, order of arrival."""
    c, q = _service(spark, sf)
    out = service.retrieve(c, q, 5)
    return out.select("query_id", "candidate_key", F.round("final_score", 6).alias("final_score"), "rank")


_TERMS = lambda x, *words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_has_any = lambda x, words: _TERMS(x, *words)
_share = lambda x, words: "(" + " + ".join(f"contains(lower({x}), '{w.lower()}')::INT" for w in dict.fromkeys(w.lower() for w in words)) + f") / {float(len(dict.fromkeys(w.lower() for w in words)))}::DOUBLE"


def _boost_sql() -> str:
    place = {"source": "source_file", "content": "content", "either": "(source_file || ' ' || content)"}
    groups = ["CASE " + " ".join(f"WHEN {_has_any('query', asked)} AND " + " AND ".join(_has_any(place[p], words) for p, words in found) + f" THEN {value}::DOUBLE" for asked, found, value in g) + " ELSE 1::DOUBLE END" for g in rules.BOOSTS]
    return " * ".join(groups)


def _service_sql() -> str:
    at = lambda column, i, plain: "CASE doc_id % 8 " + " ".join(f"WHEN {r[0]} THEN {plain if i == 2 else ''}{' || ' if i == 2 else ''}'{r[i]}'" for r in SERVICE_SOURCES) + f" ELSE {plain} END AS {column}"
    weights = "CASE " + " ".join(f"WHEN contains(source_file, '{k}') THEN {rules.AUTHORITY_WEIGHTS.get(level, rules.AUTHORITY_WEIGHTS['default'])}" for k, level in rules.AUTHORITY_KEYWORDS) + f" ELSE {rules.AUTHORITY_WEIGHTS['default']} END::DOUBLE"
    planted = ", ".join(f"({i}, '{t}')" for i, t in SERVICE_QUESTIONS)
    falls = []
    for i, (triggers, source, words) in enumerate(rules.FALLBACKS):
        gains = "".join(f" + CASE WHEN {' AND '.join(_has_any('content', p) for p in parts)} THEN {gain} ELSE 0 END" for name, g in rules.FALLBACK_GAINS.items() if name in source for parts, gain in g)
        falls.append(f"SELECT q.query_id, c.*, {i} AS rule, {_share('content', words)}{gains} AS share FROM clean c, sq q WHERE c.source_file = '{source}' AND {_has_any('query', triggers)}")
    needed = " OR ".join(_has_any("query", g) for g in rules.REQUIRED_TERM_GROUPS)
    met = " AND ".join(f"(NOT {_has_any('query', g)} OR {_has_any('content', g)})" for g in rules.REQUIRED_TERM_GROUPS)
    return "WITH " + V.VECTORS + ", " + V.CHUNKS + ", " + V.QUESTIONS + rf""", ch AS MATERIALIZED (
  SELECT v.candidate_key, CAST(v.collection AS INTEGER) AS granularity, {at('source_file', 1, 'source_file')}, page_number, {at('content', 2, 'content')}, v.e FROM vectors v JOIN chunks c ON c.doc_id = v.vec_id
), sq AS MATERIALIZED (SELECT q.*, v.e AS qe FROM (SELECT * FROM questions UNION ALL VALUES {planted}) q JOIN vectors v ON v.vec_id = q.query_id + {len(SERVICE_QUESTIONS)}
), l AS (SELECT candidate_key, content, list_transform(list_filter(regexp_split_to_array(content, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x) <> ''), lambda x: trim(trim(trim(x), '#'))) AS ls FROM ch
), noise AS (SELECT candidate_key FROM (SELECT *, regexp_replace(array_to_string(ls, ''), '[ \t\n\r\f\v#\x{{3000}}，。、《》（）()：:;；·.\-]+', '', 'g') AS k FROM l) WHERE content = '' OR len(ls) = 0 OR k = '' OR length(k) < 28 AND NOT {_has_any('content', rules.MEDICAL_SIGNALS)}
), clean AS MATERIALIZED (SELECT candidate_key, granularity, source_file, page_number, content FROM ch WHERE candidate_key NOT IN (SELECT candidate_key FROM noise)
), dn AS (SELECT q.query_id, c.candidate_key, pow(list_distance(q.qe, c.e), 2) AS d, row_number() OVER (PARTITION BY q.query_id, c.granularity ORDER BY pow(list_distance(q.qe, c.e), 2), c.candidate_key) AS rr FROM ch c, sq q QUALIFY rr <= 5
), fb AS ({' UNION ALL '.join(falls)}
), fr AS (SELECT *, least(0.92, 0.52::DOUBLE + 0.40::DOUBLE * least(1.0, share)) AS rel FROM fb WHERE share > 0
), ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, rule ORDER BY rel DESC, granularity, candidate_key) AS n FROM fr QUALIFY n <= 4
), hits AS (
  SELECT dn.query_id, c.*, 1 / (1 + d) AS rel, granularity * 1000 + rr AS arrival FROM dn JOIN clean c USING (candidate_key)
  UNION ALL SELECT query_id, candidate_key, granularity, source_file, page_number, content, rel, 10000000 + rule * 1000 + n FROM ft
), sc AS (SELECT h.*, query, rel * {weights} * ({_boost_sql()}) AS fs, {needed} AS needed, {met} AS met, {_has_any('query', rules.COMBINATION_TERMS + rules.AUDIT_TERMS + rules.BOUNDARY_TERMS)} AS broad, {_has_any('lower(content)', [w.lower() for w in rules.SAFETY_TERMS])} AS safety FROM hits h JOIN sq USING (query_id)
), am AS (SELECT *, bool_or(met) OVER (PARTITION BY query_id) AS any_met FROM sc
), kp AS (SELECT *, CASE WHEN NOT needed OR met OR NOT any_met THEN 0 ELSE 1 END AS cls, left(regexp_replace(content, '[ \t\n\r\f\v]+', '', 'g'), 120) AS sig FROM am WHERE NOT needed OR met OR (broad AND (NOT any_met OR safety))
), f1 AS (SELECT * FROM kp QUALIFY row_number() OVER (PARTITION BY query_id, source_file, page_number, sig ORDER BY cls, fs DESC, arrival) = 1)
SELECT query_id, candidate_key, round(fs, 6) AS final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cls, fs DESC, arrival) AS INTEGER) AS rank FROM f1"""


SERVICE_RETRIEVE = _service_sql()


def service_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Trust of a draft for every question: a conflict of frequencies costs most of the judge's score."""
    c, q = _service(spark, sf)
    top = write_once(service.retrieve(c, q, 5), "service-evidence")
    first = top.where("rank = 1").select("query_id", "content")
    drafts = q.join(first, "query_id", "left").select("query_id", F.when(F.col("query_id") % 9 == 0, "").otherwise("a draft").alias("draft"), service.frequency_conflict("query", F.coalesce("content", F.lit(""))).alias("conflict"))
    out = service.audit(top, drafts, F.lit(9.0), F.col("conflict"))
    return out.select("query_id", F.round("s_ret", 6).alias("s_ret"), "s_faith", "w_authority", "trust_level")


SERVICE_AUDIT = SERVICE_RETRIEVE.rpartition("SELECT query_id, candidate_key, round(fs, 6)")[0] + """, fst AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cls, fs DESC, arrival) = 1
), a AS (SELECT q.query_id, q.query_id % 9 = 0 OR rel IS NULL AS nothing, rel, content, query, """ + SERVICE_RETRIEVE.partition(" AS fs,")[0].rpartition("rel * ")[2].partition(" * (CASE")[0] + r""" AS w FROM (SELECT query_id FROM sq) q LEFT JOIN fst USING (query_id)
), b AS (SELECT query_id, CASE WHEN nothing THEN 0 ELSE rel * 10 END AS s_ret, CASE WHEN nothing THEN 0.0 WHEN regexp_matches(query, '(?i)(\bbid\b|每日\s*(两|二|2)\s*次|一天\s*(两|二|2)\s*次)') AND regexp_matches(content, '(?i)(\bqd\b|每日\s*(一|1)\s*次|一天\s*(一|1)\s*次)') THEN 2.0 ELSE 9.0 END::DOUBLE AS s_faith, CASE WHEN nothing THEN 0 ELSE w END::DOUBLE AS w FROM a
), t AS (SELECT *, round((0.4::DOUBLE * least(10, s_ret) + 0.6::DOUBLE * s_faith) * w, 4) AS ts FROM b)
SELECT query_id, round(s_ret, 6) AS s_ret, s_faith, w AS w_authority, CASE WHEN ts >= 7.5 THEN 'TRUSTED' WHEN ts > 5 THEN 'WARNING' ELSE 'REJECTED' END AS trust_level FROM t"""

QUERIES = {
    "trust_gate": (trust_gate, TRUST_GATE),
    "dense_topk": (dense_topk, DENSE_TOPK),
    "sparse_topk": (sparse_topk, SPARSE_TOPK),
    "rrf_fusion": (rrf_fusion, RRF_FUSION),
    "rrf_page_fusion": (rrf_page_fusion, RRF_PAGE_FUSION),
    "method_fusion": (method_fusion, METHOD_FUSION),
    "rerank_ranks": (rerank_ranks, RERANK_RANKS),
    "greedy_dedup": (greedy_dedup, GREEDY_DEDUP),
    "admit_evidence": (admit_evidence, ADMIT_EVIDENCE),
    "dedup_first": (dedup_first, DEDUP_FIRST),
    "query_expansion": (query_expansion, QUERY_EXPANSION),
    "authority_weights": (authority_weights, AUTHORITY_WEIGHTS),
    "noise_chunks": (noise_chunks, NOISE_CHUNKS),
    "neighbour_pages": (neighbour_pages, NEIGHBOUR_PAGES),
    "physical_dedup": (physical_dedup, PHYSICAL_DEDUP),
    "evidence_snippets": (evidence_snippets, EVIDENCE_SNIPPETS),
    "char_overlap": (char_overlap, CHAR_OVERLAP),
    "service_retrieve": (service_retrieve, SERVICE_RETRIEVE),
    "service_audit": (service_audit, SERVICE_AUDIT),
}
