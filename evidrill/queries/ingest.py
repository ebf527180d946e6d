"""Queries of the smaller stages: store filters, page tracks, statuses, gates, roles, leaks, streams, canonical forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions import text as X
from evidrill.operators import anchors as AN
from evidrill.operators import contracts as K
from evidrill.operators import evaluation as E
from evidrill.operators import evidence_graph as EG
from evidrill.operators import graph as G
from evidrill.operators import retrieval as R
from evidrill.queries import anchors as QA
from evidrill.queries import graph as Q
from evidrill.queries import views as V
from evidrill.queries.graph import _EVIDENCE, _m
from evidrill.queries.retrieval import _RRF
from evidrill.sources import files as S
from evidrill.streaming import events as ST


def intent_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Which granularities a question of each intent is looked up at."""
    q = V.questions(spark, sf).select("query_id", F.element_at(F.array(F.lit("DETAIL"), F.lit("CONCEPT"), F.lit("OTHER")), (F.col("query_id") % 3 + 1).cast("int")).alias("intent"))
    return q.select("query_id", F.explode(R.granularities_of(F.col("intent"))).alias("granularity"))


INTENT_ROUTES = "SELECT item_id AS query_id, CAST(unnest(CASE item_id % 3 WHEN 0 THEN [128] WHEN 1 THEN [512] ELSE [128, 512, 1024] END) AS INTEGER) AS granularity FROM benchmark"


def ready_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of an index whose collections are all complete, and none of one with a gap."""
    top = V.routed(spark, sf).where("method_id = 'sparse'").select("query_id", "candidate_key", "rank")
    whole = V.table(spark, sf, "region").select(F.lit(True).alias("complete"))
    gap = V.table(spark, sf, "region").select((F.col("r_regionkey") > 0).alias("complete"))
    return R.index_ready(top, whole).withColumn("kind", F.lit("whole")).unionByName(R.index_ready(top, gap).withColumn("kind", F.lit("gap")))


READY_RESULTS = "WITH " + V.ROUTED + " SELECT query_id, candidate_key, rank, 'whole' AS kind FROM routed WHERE method_id = 'sparse'"


def checked_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of a sparse encoder, zeros left out, every token inside the vocabulary."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").cast("int").alias("token_id"), F.col("l_discount").alias("weight"))
    return R.check_weights(li, 1 << 30).groupBy("document_id").agg(F.count("*").alias("nnz"), F.round(F.sum("weight"), 6).alias("total"))


CHECKED_WEIGHTS = "SELECT l_orderkey AS document_id, count(*) AS nnz, round(sum(l_discount), 6) AS total FROM lineitem WHERE l_discount <> 0 GROUP BY 1"


def merged_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Text and table blocks of each source in the order of pages, text first."""
    c = V.chunks(spark, sf).select("source_file", "page_number", F.col("doc_id").alias("seq"), F.contains("content", F.lit(" | ")).alias("t"))
    return S.merge_tracks(c.where("NOT t").drop("t"), c.where("t").drop("t"), ["source_file"]).select("source_file", "seq", "block_order")


MERGED_TRACKS = "WITH " + V.CHUNKS + " SELECT source_file, doc_id AS seq, CAST(row_number() OVER (PARTITION BY source_file ORDER BY page_number, contains(content, ' | '), doc_id) AS INTEGER) AS block_order FROM chunks"


def filtered_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store scan with equality filters."""
    return S.where_equal(V.table(spark, sf, "lineitem"), l_returnflag="R", l_linestatus="F").groupBy("l_linenumber").agg(F.count("*").alias("n"))


FILTERED_STORE = "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1"


def manifest_states(spark: SparkSession, sf: str) -> DataFrame:
    """Sources after a download that may have failed, or fetched something else."""
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "downloaded").otherwise("registered").alias("status"), (F.col("o_orderkey") % 3 != 0).alias("fetched"), F.when(F.col("o_orderkey") % 5 == 0, "<htm").otherwise("%PDF").alias("head"))
    return S.manifest_status(o, F.col("fetched"), F.col("head")).groupBy("status").agg(F.count("*").alias("n"))


MANIFEST_STATES = "SELECT CASE WHEN o_orderstatus = 'F' OR (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0) THEN 'downloaded' ELSE 'download_failed' END AS status, count(*) AS n FROM orders GROUP BY 1"


def output_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Heuristic flags of assistants' answers, with frequent words for refusals, claims and dangers."""
    t = V.table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("answer"), F.when(F.col("turn") % 2 == 0, "boundary_refusal").otherwise("allow").alias("expected_decision"), (F.col("turn") % 3).alias("snippet_count"))
    out = E.output_risk_flags(t, ("the ",), ("and",), ("not",), ("is",))
    return out.select("conv_id", "turn", "refuses", "refusal_correct", "unsupported_claim", "unsafe_answer")


OUTPUT_FLAGS = """WITH a AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, turn % 2 = 0 AS should, turn % 3 AS snips FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, contains(t, 'the ') AS refuses, contains(t, 'the ') = should AS refusal_correct, contains(t, 'is') AND snips = 0 AND NOT contains(t, 'the ') AS unsupported_claim, contains(t, 'and') AND NOT contains(t, 'not') AND should AS unsafe_answer FROM a"""


def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents on and off the pages that hold a benchmark passage."""
    c = V.chunks(spark, sf).select(F.col("source_file").alias("source_id"), "page_number", "doc_id")
    used = V.gold(spark, sf).select(F.col("source_file").alias("source_id"), "page_number")
    free, taken = AN.split_overlap(c, used)
    return free.select("doc_id", F.lit(False).alias("overlaps")).unionByName(taken.select("doc_id", F.lit(True).alias("overlaps")))


SPLIT_OVERLAP = "WITH " + V.GOLD + " SELECT doc_id, EXISTS (SELECT 1 FROM gold g WHERE g.source_file = c.source_file AND g.page_number = c.page_number) AS overlaps FROM chunks c"


def reviewed_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their authors' decisions."""
    d = V.chunks(spark, sf).select(F.col("doc_id").alias("candidate_id"))
    decisions = V.table(spark, sf, "labels").select(F.col("doc_id").alias("candidate_id"), F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject").alias("author_decision"))
    return AN.reviewed_pool(d, decisions).select("candidate_id", "pool_status")


REVIEWED_POOL = "SELECT doc_id AS candidate_id, CASE WHEN quality = 1 THEN 'accepted' WHEN quality IS NULL THEN 'pending' ELSE 'rejected' END AS pool_status FROM documents LEFT JOIN labels USING (doc_id)"


def row_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every broken rule of each order, some of them conditional on another field."""
    o = V.table(spark, sf, "orders")
    checks = [("cheap", F.col("o_totalprice") < 100000), ("final_but_urgent", (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")), ("open_without_priority", (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("4"))]
    return K.all_violations(o, checks).where(F.size("violations") > 0).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


ROW_VIOLATIONS = "SELECT * FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 100000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'F' AND starts_with(o_orderpriority, '1') THEN 'final_but_urgent' END, CASE WHEN o_orderstatus = 'O' AND starts_with(o_orderpriority, '4') THEN 'open_without_priority' END) AS violations FROM orders) WHERE violations <> ''"


def source_status(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the coverage matrix with their candidates."""
    c = V.chunks(spark, sf).select(F.col("source_file").alias("source_id"))
    return AN.source_status(c, c.distinct().unionByName(spark.createDataFrame([("never",)], "source_id string")))


SOURCE_STATUS = "SELECT source AS source_id, count(*) AS candidate_count, 'candidates_ready' AS status FROM documents GROUP BY 1 UNION ALL SELECT 'never', 0, 'no_candidates'"


def provenance_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as candidates whose nation and region must be those of their nation's row; nation 3 is not admitted."""
    n = V.table(spark, sf, "nation")
    c = V.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_nationkey").alias("source_id"), "n_name", (F.col("n_regionkey") + (F.col("c_custkey") % 10 == 0).cast("int")).alias("n_regionkey"))
    coverage = n.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("source_id"), "n_name", "n_regionkey")
    out = AN.provenance_failures(c, coverage, ["n_name", "n_regionkey"])
    return out.where(F.size("failed") > 0).select("c_custkey", F.array_join("failed", ",").alias("failed"))


PROVENANCE_FAILURES = "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'unknown_source' ELSE 'n_regionkey' END AS failed FROM customer WHERE c_nationkey = 3 OR c_custkey % 10 = 0"


def candidate_roles(spark: SparkSession, sf: str) -> DataFrame:
    """C14: two questions of each part, one within its scope and one beyond it."""
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("anchor_id"), F.split("p_type", " ").alias("claim_types"), F.col("p_brand").alias("scope"), F.col("p_name").alias("boundary"))
    decision = AN.boundary_decision(F.col("claim_types"), F.col("scope"), F.col("boundary"), ("STEEL",), ("Brand#1",), ("a",))
    return AN.candidate_roles(p, decision).select("anchor_id", "role", "expected_decision", "question_id")


CANDIDATE_ROLES = "SELECT p_partkey AS anchor_id, role, CASE WHEN role = 'supported' THEN 'allow_supported_answer' WHEN list_contains(string_split(p_type, ' '), 'STEEL') OR contains(p_brand, 'Brand#1') OR contains(p_name, 'Brand#1') THEN 'insufficient_evidence' WHEN contains(p_name, 'a') THEN 'boundary_refusal' ELSE 'review_required' END AS expected_decision, 'Q-' || left(sha256(p_partkey || '|' || role), 20) AS question_id FROM part, (VALUES ('supported'), ('boundary')) r(role)"


def evaluation_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the graphs that gold passages are laid over, by type; the span that is there already is not added."""
    nodes, edges, _ = QA._graph(spark, sf)
    g = V.gold(spark, sf).join(V.chunks(spark, sf).select("candidate_key", "content"), "candidate_key")
    gold = g.where("source_file <> 'src7'").select(F.col("query_id").alias("sample_id"), F.concat(F.lit("S-"), "source_file").alias("source_id"), "page_number", F.col("content").alias("anchor_text_span"), F.lit("Allow Answer").alias("expected_decision"), F.array(F.lit("dose"), F.lit("Age")).alias("risk_labels"), F.array(F.lit("one claim")).alias("claims"))
    more, _ = EG.evaluation_graph(nodes, edges, gold)
    return more.groupBy("node_type").agg(F.count("*").alias("nodes"))


EVALUATION_GRAPH = "WITH " + _RRF + """, ev AS (SELECT query_id, c.source_file, c.page_number, content, bool_or(c.source_file = 'src7') OVER (PARTITION BY query_id) AS bad FROM fused JOIN chunks c USING (candidate_key) WHERE frank <= 4
), ok AS (SELECT DISTINCT query_id, source_file, page_number, trim(regexp_replace(lower(trim(content)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM ev WHERE NOT bad
), gl AS (SELECT g.query_id, g.source_file, g.page_number, trim(regexp_replace(lower(trim(content)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM gold g JOIN (SELECT candidate_key, content FROM chunks) USING (candidate_key) WHERE g.source_file <> 'src7'), n AS (SELECT count(*) AS n FROM gl)
SELECT 'Question' AS node_type, count(*) AS nodes FROM questions WHERE query_id NOT IN (SELECT query_id FROM ev WHERE bad)
UNION ALL SELECT 'SourceDocument', count(*) FROM (SELECT query_id, source_file FROM ok UNION SELECT query_id, source_file FROM gl) UNION ALL SELECT 'EvidenceSpan', count(*) FROM (SELECT * FROM ok UNION SELECT * FROM gl)
UNION ALL SELECT 'Decision', n FROM n UNION ALL SELECT 'RiskLabel', 2 * n FROM n UNION ALL SELECT 'Claim', n FROM n"""


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of a batch run by status."""
    return EG.batch_summary(QA._graph(spark, sf)[2]).select("build_status", "samples", F.col("spans").cast("long").alias("spans"))


BATCH_SUMMARY = "SELECT build_status, count(*) AS samples, CAST(sum(spans) AS BIGINT) AS spans FROM (" + QA.INFERENCE_GRAPH_STATUS + ") GROUP BY 1"


def claims_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """questions' constraints as claims, against the first two pieces of evidence before and after a reversal."""
    q = V.query_constraints(spark, sf).select(F.col("query_id").alias("answer_id"), F.concat_ws(":", "ctype", "cvalue").alias("claim_id"), "ctype", "cvalue", F.lit("assert").alias("stance"))
    e = Q._evidence_constraints(spark, sf).where("scope = 'content'").select(F.col("query_id").alias("answer_id"), "ctype", "cvalue", F.col("rank").alias("before"), (5 - F.col("rank")).alias("after"))
    out = EG.claims_by_order(q, e, ("before", "after"), 2)
    return out.select(F.col("answer_id").alias("query_id"), "evidence_order", "claims", *G.CLAIM_STATES)


CLAIMS_BY_ORDER = "WITH " + _EVIDENCE + """, od(evidence_order) AS (VALUES ('before'), ('after')
), v AS (SELECT DISTINCT query_id, ctype, cvalue, evidence_order FROM ec, od WHERE scope = 'content' AND CASE evidence_order WHEN 'before' THEN rank ELSE 5 - rank END <= 2
), s AS (SELECT q.query_id, od.evidence_order, q.ctype, q.cvalue, coalesce(bool_or(""" + _m + """), false) AS m, coalesce(bool_or(NOT """ + _m + """ AND NOT (q.ctype = 'route' AND q.cvalue LIKE 'iv%' AND e.cvalue LIKE 'iv%') AND q.ctype IN ('dose', 'frequency', 'route', 'monitoring_window', 'monitoring_action', 'contraindication_action', 'evidence_scope')), false) AS x
  FROM qc q CROSS JOIN od LEFT JOIN v e ON e.query_id = q.query_id AND e.ctype = q.ctype AND e.evidence_order = od.evidence_order GROUP BY ALL)
SELECT query_id, evidence_order, count(*) AS claims, count(*) FILTER (NOT m AND x) AS contradicted, count(*) FILTER (NOT m AND NOT x) AS unsupported, CAST(0 AS BIGINT) AS insufficient_evidence, count(*) FILTER (m) AS supported FROM s GROUP BY ALL"""


def leaked_values(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text holds a benchmark passage, which runtime data must not."""
    return K.leaked_values(V.chunks(spark, sf).select("doc_id", "content", "source_file"), "doc_id", V.questions(spark, sf).select("query"))


LEAKED_VALUES = "WITH " + V.CHUNKS + ", " + V.QUESTIONS + " SELECT doc_id, 'content' AS field FROM chunks WHERE EXISTS (SELECT 1 FROM questions WHERE query <> '' AND contains(content, query))"


def reassembled_events(spark: SparkSession, sf: str) -> DataFrame:
    """2.12: the relay's lines cut into pieces of ten characters, put together again and read."""
    r = V.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("turns"))
    e = ST.relay_events(r, F.col("turns") % 5 == 0, F.col("turns") % 7 == 0)
    line = F.concat(F.lit("data: "), F.to_json(F.struct("type", "node")), F.lit("\n\n"))
    whole = e.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "").alias("t"))
    pieces = whole.select("session_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 10).cast("int")), lambda i: F.substr("t", i * 10 + 1, F.lit(10)))).alias("piece", "data"))
    return ST.parse_events(ST.reassemble(pieces)).groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "node_update").alias("updates"))


REASSEMBLED_EVENTS = "SELECT session_id, CAST(CASE WHEN turns % 7 = 0 THEN 2 WHEN turns % 5 = 0 THEN 3 ELSE 6 END AS BIGINT) AS events, CAST(CASE WHEN turns % 7 = 0 THEN 0 WHEN turns % 5 = 0 THEN 1 ELSE 4 END AS BIGINT) AS updates FROM (SELECT conv_id AS session_id, max(turn) AS turns FROM conversations GROUP BY 1)"


def unrepeated_events(spark: SparkSession, sf: str) -> DataFrame:
    """2.12, extension: events of which some arrive twice, each counted once."""
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.without_repeats(e.unionByName(e.where("event_id % 10 = 0"))).groupBy("event_type").agg(F.count("*").alias("n"))


UNREPEATED_EVENTS = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


def canonical_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Decimals as the shortest text, and key-sorted JSON of a row under a digest."""
    p = V.table(spark, sf, "part")
    row = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    return p.select("p_partkey", X.canonical_number(F.col("p_size") / 4).alias("quarter"), X.canonical_json(row).alias("json"))


CANONICAL_FORMS = """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_size // 4 AS VARCHAR) WHEN 1 THEN p_size // 4 || '.25' WHEN 2 THEN p_size // 4 || '.5' ELSE p_size // 4 || '.75' END AS quarter, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '"}' AS json FROM part"""


def ordered_export(spark: SparkSession, sf: str) -> DataFrame:
    """A store's rows in the order of their key, whose keys are unique and there."""
    return S.ordered_export(V.table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


ORDERED_EXPORT = "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey"

_NAMES = (
    "intent_routes ready_results checked_weights merged_tracks filtered_store manifest_states output_flags split_overlap reviewed_pool row_violations source_status provenance_failures candidate_roles "
    "evaluation_graph batch_summary claims_by_order leaked_values reassembled_events unrepeated_events canonical_forms ordered_export"
).split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in _NAMES}
