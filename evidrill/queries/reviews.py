"""Queries of the second looks: scope and overlap audits, batches, traces, coverage, budgets, judge outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions import rules
from evidrill.functions.text import norm_text
from evidrill.operators import anchors as AN
from evidrill.operators import audits as A
from evidrill.operators import evaluation as E
from evidrill.operators import graph as G
from evidrill.operators import retrieval as R
from evidrill.operators import reviews as W
from evidrill.queries import graph as Q
from evidrill.queries import views as V
from evidrill.queries.curation import _TURNS, _turns
from evidrill.queries.evaluation import _METRICS
from evidrill.queries.graph import _EXPAND, _PAIRS, _PATHS, _ROUTE, CONSTRAINT_AUDIT, COVERAGE_RERANK, GRAPH_RERANK, ROUTE_ACTIONS
from evidrill.queries.retrieval import _GRAMS, _NORM, NEIGHBOUR_PAGES
from evidrill.sources.scratch import write_once

#: Questions that the boundary must stop, or let pass, whatever the tables hold.
PLANTED = ((-1, "请帮我 开处\t方，宝宝咳嗽"), (-2, "处方药有哪些"), (-3, "儿童 发热怎么办"), (-4, "这个孩子的用 药方案"))


def prescription_boundary(spark: SparkSession, sf: str) -> DataFrame:
    q = V.questions(spark, sf).unionByName(spark.createDataFrame(list(PLANTED), "query_id long, query string"))
    return q.select("query_id", rules.asks_prescription("query").alias("refused"))


PRESCRIPTION_BOUNDARY = "WITH " + V.QUESTIONS + ", q AS (SELECT * FROM questions UNION ALL VALUES " + ", ".join(f"({i}, '{t}')" for i, t in PLANTED) + r"""), t AS (SELECT query_id, regexp_replace(query, '\s+', '', 'g') AS t FROM q)
SELECT query_id, regexp_matches(t, '处方|开药|用药方案') AND regexp_matches(t, '这个孩子|患儿|宝宝|婴儿|儿童|发热|咳嗽') AS refused FROM t"""


def shortlist_relevance(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(" 1 ..... 2 ...... [3] [ 4 ]"))).otherwise(F.col("content")))
    return c.select("doc_id", AN.shortlist_noise("text").alias("noise"), AN.is_relevant("text", "source_file", ("src1", "North")).alias("relevant"))


_WS = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
SHORTLIST_RELEVANCE = "WITH " + V.CHUNKS + ", t AS (SELECT doc_id, source_file, " + _WS.format("CASE WHEN doc_id % 10 = 0 THEN content || ' 1 ..... 2 ...... [3] [ 4 ]' ELSE content END") + r""" AS t FROM chunks
), f AS (SELECT *, len(regexp_extract_all(t, '\.{3,}|…{3,}')) >= 2 AS noise FROM t)
SELECT doc_id, noise, NOT noise AND NOT (contains(t, '参考文献') OR contains(lower(t), 'references') OR contains(lower(t), 'bibliography')) AND len(regexp_extract_all(t, '(\[|［)\s*[0-9]+\s*(\]|］)')) <= 1
  AND (contains(lower(source_file), 'src1') OR contains(lower(source_file), 'north') OR contains(lower(t), 'src1') OR contains(lower(t), 'north')) AS relevant FROM f"""


def limited_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source's evidence types are the languages of its longest and its shortest document."""
    at = F.struct(F.length("content"), "doc_id")
    g = V.chunks(spark, sf).groupBy("source_file").agg(F.array_compact(F.array(F.max_by("lang", at), F.min_by("lang", at))).alias("types"))
    return g.select("source_file", AN.scope_limited(F.col("types"), ("en", "fr")).alias("limited"))


LIMITED_SOURCES = "WITH " + V.CHUNKS + ", t AS (SELECT source_file, list_filter([arg_max(lang, (length(content), doc_id)), arg_min(lang, (length(content), doc_id))], lambda x: x IS NOT NULL) AS l FROM chunks GROUP BY source_file) SELECT source_file, len(l) > 0 AND len(list_filter(l, lambda x: x NOT IN ('en', 'fr'))) = 0 AS limited FROM t"


def scope_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rows, their sources' pages by tens as units; words stand for medication terms and reasons."""
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    none = F.array().cast("array<string>")
    rows = d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", (F.col("doc_id") % 3).cast("string")).alias("unit"), F.when(F.col("quality") == 0, "reject").otherwise("keep").alias("outcome"), F.substring("text", 1, 60).alias("question"), F.col("text").alias("reason"), F.array("lang").alias("claim_types"), none.alias("evidence_types"), none.alias("risk_labels"))
    out = W.scope_flags(rows, ("the", "la"), ("de",), ("and", "und"), ("keep",))
    return out.select("id", F.array_join("reasons", ",").alias("reasons"))


SCOPE_FLAGS = """WITH r AS (SELECT doc_id AS id, concat_ws('/', source, doc_id % 3) AS unit, quality, coalesce(text, '') AS text, concat_ws(' ', left(text, 60), lang) AS said, lang FROM documents JOIN labels USING (doc_id)
), x AS (SELECT DISTINCT unit FROM r WHERE quality = 0 AND (contains(text, 'and') OR contains(text, 'und'))
), f AS (SELECT id, coalesce(lang = 'de', false) AS o, x.unit IS NOT NULL AS s FROM r LEFT JOIN x ON x.unit = r.unit WHERE coalesce(quality, 1) <> 0 AND NOT (contains(said, 'the') OR contains(said, 'la')))
SELECT id, concat_ws(',', 'no_explicit_medication_link', CASE WHEN o THEN 'non_medication_claim_type' END, CASE WHEN s THEN 'sibling_scope_inconsistency' END) AS reasons FROM f WHERE o OR s"""


def method_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as outputs of their order; unfilled ones are unusable. Pairs and samples left out, as one table."""
    li = V.table(spark, sf, "lineitem")
    o = li.select(F.col("l_orderkey").alias("sample_id"), F.concat(F.lit("m"), "l_linenumber").alias("method_id"), F.col("l_partkey").cast("string").alias("cache_key"), F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"), F.col("l_returnflag").alias("raw_output"))
    pairs, few = W.method_pairs(o, ("v1",))
    return pairs.select("sample_id", "method_a", "method_b", "judge_cache_key").unionByName(few.select("sample_id", F.lit("").alias("method_a"), F.lit("").alias("method_b"), F.lit("fewer_than_two_usable_outputs").alias("judge_cache_key")))


METHOD_PAIRS = """WITH u AS (SELECT l_orderkey AS s, 'm' || l_linenumber AS m, CAST(l_partkey AS VARCHAR) AS k FROM lineitem WHERE l_linestatus = 'F' AND trim(l_returnflag) <> '')
SELECT a.s AS sample_id, a.m AS method_a, b.m AS method_b, sha256(concat_ws('|', a.s, a.m, b.m, a.k, b.k, 'v1')) AS judge_cache_key FROM u a JOIN u b ON a.s = b.s AND a.m < b.m
UNION ALL SELECT s, '', '', 'fewer_than_two_usable_outputs' FROM u GROUP BY s HAVING count(*) < 2"""


def challenge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as anchors, orders as parents; every specification gives a candidate or the reason why not."""
    li, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    parents = li.groupBy(F.col("l_orderkey").alias("parent_id")).agg(F.collect_list("l_partkey").alias("anchor_ids"))
    specs = p.where("p_partkey % 7 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 0, 10_000_000).otherwise(0)).alias("anchor_id"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name")).alias("question"), F.when(F.col("p_size") > 25, "boundary_refusal").otherwise("review_required").alias("decision"))
    again = p.where("p_partkey % 70 = 0").select(F.col("p_partkey").alias("anchor_id"), F.col("p_name").alias("question"), F.lit("review_required").alias("decision"))
    good, bad = W.challenge_candidates(specs.unionByName(again), p.select(F.col("p_partkey").alias("anchor_id")), parents, "v1")
    return good.select("anchor_id", "candidate_id", "scenario", "parent_id").unionByName(bad.select("anchor_id", F.col("problem").alias("candidate_id"), F.lit("").alias("scenario"), F.lit(-1).cast("long").alias("parent_id")))


CHALLENGE_CANDIDATES = """WITH pa AS (SELECT k AS anchor_id, min(o) AS parent_id FROM (SELECT l_orderkey AS o, min(l_partkey) AS k FROM lineitem GROUP BY 1 HAVING count(*) = 1) GROUP BY k
), sp AS (SELECT p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 10000000 ELSE 0 END AS anchor_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS question, CASE WHEN p_size > 25 THEN 'boundary_refusal' ELSE 'review_required' END AS decision FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, p_name, 'review_required' FROM part WHERE p_partkey % 70 = 0
), s AS (SELECT sp.*, count(*) OVER (PARTITION BY sp.anchor_id) AS uses, p_partkey IS NOT NULL AS known, pa.parent_id FROM sp LEFT JOIN part ON p_partkey = sp.anchor_id LEFT JOIN pa ON pa.anchor_id = sp.anchor_id
), b AS (SELECT *, CASE WHEN uses > 1 THEN 'anchor_used_again' WHEN NOT known THEN 'unknown_anchor' WHEN parent_id IS NULL THEN 'no_parent' WHEN question = '' THEN 'empty_question' END AS problem FROM s)
SELECT anchor_id, coalesce(problem, 'BV1S-' || left(sha256(anchor_id || '|' || question || '|v1'), 16)) AS candidate_id, CASE WHEN problem IS NOT NULL THEN '' WHEN decision = 'boundary_refusal' THEN 'prescription-boundary' ELSE 'evidence-scope' END AS scenario, CASE WHEN problem IS NULL THEN parent_id ELSE -1 END AS parent_id FROM b"""


def _revised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revised questions, other questions with their units, a development set with exact and near repetitions)."""
    t = write_once(_turns(spark, sf), "turns").withColumn("unit", F.col("id") % 10)
    dev = V.questions(spark, sf).select(F.col("query_id").alias("id"), norm_text("query").alias("norm"))
    dev = dev.unionByName(t.where("id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), "norm")).unionByName(t.where("id % 4 = 1").select((F.col("id") + 2_000_000).alias("id"), F.concat("norm", F.lit("zq")).alias("norm")))
    return t, t, dev


_REVISED = "WITH " + _TURNS + ", " + V.QUESTIONS + f""", t AS (SELECT id, norm, id % 10 AS unit FROM turns), rev AS (SELECT * FROM t
), dev AS (SELECT query_id AS id, {_NORM.format('query')} AS norm FROM questions UNION ALL SELECT id + 1000000, norm FROM t WHERE id % 4 = 0 UNION ALL SELECT id + 2000000, norm || 'zq' FROM t WHERE id % 4 = 1
), gr AS MATERIALIZED (SELECT id, unit, norm, {_GRAMS.format('norm')} AS g FROM rev), gd AS MATERIALIZED (SELECT id, norm, {_GRAMS.format('norm')} AS g FROM dev), gt AS MATERIALIZED (SELECT id, unit, norm, {_GRAMS.format('norm')} AS g FROM t
), pd AS (SELECT gr.id, gd.id AS o, gr.norm = gd.norm AS e, CASE WHEN len(gr.g) > 0 AND len(gd.g) > 0 THEN len(list_intersect(gr.g, gd.g)) / (len(gr.g) + len(gd.g) - len(list_intersect(gr.g, gd.g))) ELSE 0 END AS j FROM gr, gd
), pt AS (SELECT gr.id, gt.id AS o, gr.norm = gt.norm AS e, CASE WHEN len(gr.g) > 0 AND len(gt.g) > 0 THEN len(list_intersect(gr.g, gt.g)) / (len(gr.g) + len(gt.g) - len(list_intersect(gr.g, gt.g))) ELSE 0 END AS j FROM gr, gt WHERE gr.unit <> gt.unit
), dd AS (SELECT r.id, min(o) FILTER (e) AS x, arg_max(o, (j, -o)) FILTER (j >= 0.65) AS n FROM rev r LEFT JOIN pd ON pd.id = r.id GROUP BY r.id
), dt AS (SELECT r.id, min(o) FILTER (e) AS x, arg_max(o, (j, -o)) FILTER (j >= 0.65) AS n FROM rev r LEFT JOIN pt ON pt.id = r.id GROUP BY r.id)"""


def parent_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rev, _, dev = _revised(spark, sf)
    return W.overlap_decision(rev.select("id", "norm"), dev, 0.65)


PARENT_OVERLAP = _REVISED + " SELECT id, CASE WHEN x IS NOT NULL THEN 'reject' WHEN n IS NOT NULL THEN 'needs_review' ELSE 'keep' END AS decision, CASE WHEN x IS NOT NULL THEN 'exact_question_parent' WHEN n IS NOT NULL THEN 'near_duplicate_parent' END AS reason, coalesce(x, n) AS other_id FROM dd"


def overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    """First questions, some of them twice, against a development set and one another."""
    rev, _, dev = _revised(spark, sf)
    rev = rev.unionByName(rev.where("id % 6 = 0").select((F.col("id") + 3_000_000).alias("id"), "norm", "unit")).unionByName(rev.where("id % 6 = 3").select((F.col("id") + 4_000_000).alias("id"), F.concat("norm", F.lit("qx")).alias("norm"), (F.col("unit") + 1).alias("unit")))
    out = W.overlap_audit(rev, dev, 0.65)
    return out.select("id", "decision", F.array_join("reasons", ",").alias("reasons"), "canonical_id")


OVERLAP_AUDIT = _REVISED.replace("rev AS (SELECT * FROM t\n)", "rev AS (SELECT * FROM t UNION ALL SELECT id + 3000000, norm, unit FROM t WHERE id % 6 = 0 UNION ALL SELECT id + 4000000, norm || 'qx', unit + 1 FROM t WHERE id % 6 = 3\n)") + """, cn AS (SELECT id, min(id) OVER (PARTITION BY CASE WHEN norm = '' THEN 'id' || id ELSE norm END) AS canonical_id FROM rev
), nr AS (SELECT DISTINCT a.id FROM gr a JOIN gr b ON a.unit <> b.unit AND a.id <> b.id AND len(a.g) > 0 AND len(b.g) > 0 WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.65
), f AS (SELECT dd.id, x IS NOT NULL AS ex, x IS NULL AND n IS NOT NULL AS ne, canonical_id <> dd.id AS cp, nr.id IS NOT NULL AS rv, canonical_id FROM dd JOIN cn ON cn.id = dd.id LEFT JOIN nr ON nr.id = dd.id)
SELECT id, CASE WHEN ex OR cp THEN 'reject' WHEN ne OR rv THEN 'needs_review' ELSE 'keep' END AS decision, concat_ws(',', CASE WHEN ex THEN 'exact_question_dev' WHEN ne THEN 'near_duplicate_dev' END, CASE WHEN cp THEN 'duplicate_candidate' END, CASE WHEN rv AND NOT cp THEN 'near_duplicate_candidate' END) AS reasons, canonical_id FROM f"""


def revision_reaudit(spark: SparkSession, sf: str) -> DataFrame:
    rev, own, dev = _revised(spark, sf)
    parts = {"dev50": W.overlap_decision(rev.select("id", "norm"), dev, 0.65, name="dev50"), "internal": W.overlap_decision(rev, own, 0.65, name="internal", same_unit=False)}
    return W.reaudit(parts).select("id", "decision", F.array_join("reasons", ",").alias("reasons"))


REVISION_REAUDIT = _REVISED + """ SELECT dd.id, CASE WHEN dd.x IS NOT NULL OR dt.x IS NOT NULL THEN 'reject' WHEN dd.n IS NOT NULL OR dt.n IS NOT NULL THEN 'needs_review' ELSE 'clear' END AS decision,
  concat_ws(',', CASE WHEN dd.x IS NOT NULL THEN 'exact_question_dev50' END, CASE WHEN dt.x IS NOT NULL THEN 'exact_question_internal' END, CASE WHEN dd.x IS NULL AND dd.n IS NOT NULL THEN 'near_duplicate_dev50' END, CASE WHEN dt.x IS NULL AND dt.n IS NOT NULL THEN 'near_duplicate_internal' END) AS reasons FROM dd JOIN dt USING (id)"""


def review_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates after manual decisions on what needed review; one in three is decided, and of those every second kept."""
    audited = write_once(parent_overlap(spark, sf).select("id", "decision"), "audited")
    review = audited.where("decision = 'needs_review'").select("id", F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "keep").otherwise("reject")).alias("manual_decision"))
    stays, waiting = W.after_review(audited, review)
    return stays.select("id", F.lit("stays").alias("state")).unionByName(waiting.select("id", F.lit("undecided").alias("state")))


REVIEW_SELECTION = _REVISED + ", a AS (SELECT id, CASE WHEN x IS NOT NULL THEN 'reject' WHEN n IS NOT NULL THEN 'needs_review' ELSE 'keep' END AS d FROM dd) SELECT id, 'stays' AS state FROM a WHERE d = 'keep' OR d = 'needs_review' AND id % 3 = 0 AND id % 2 = 0 UNION ALL SELECT id, 'undecided' FROM a WHERE d = 'needs_review' AND id % 3 <> 0"


def decision_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as drafts, labels as decisions, with some of documents that do not exist and some given twice."""
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "accept").otherwise("other").alias("decision"))
    extra = labels.where("id % 10 = 0").unionByName(spark.createDataFrame([(-1, "accept")], "id long, decision string"))
    return W.decision_coverage(V.chunks(spark, sf).select(F.col("doc_id").alias("id")), labels.unionByName(extra), ("accept", "reject"))


DECISION_COVERAGE = "SELECT doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'not_decided' WHEN doc_id % 10 = 0 THEN 'decided_again' ELSE 'decision_not_allowed' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR doc_id % 10 = 0 OR coalesce(l.quality, 0) <> 1 UNION ALL SELECT -1, 'unknown_id'"


def author_batches(spark: SparkSession, sf: str) -> DataFrame:
    return W.author_batches(V.chunks(spark, sf).select("source_file", "doc_id"), "source_file", ["doc_id"], 12).select("doc_id", "batch")


AUTHOR_BATCHES = "WITH n AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS part FROM documents) SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source, part) AS INTEGER) AS batch FROM n"


def batch_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as a queue whose clean rows are done; the batch is its next rows, with some that may not be applied."""
    q = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("place"), F.when(F.col("quality") == 1, "done").alias("outcome"))
    pending = q.where("outcome IS NULL")
    nth = R.ranked(pending.withColumn("g", F.lit(1)), ["g"], [F.col("place")], name="n")
    batch = nth.where("n <= 10 OR n = 30").select("id", F.lit("reviewed").alias("outcome")).unionByName(q.where("outcome = 'done'").select("id", F.lit("again").alias("outcome")).orderBy("id").limit(3)).unionByName(spark.createDataFrame([(-5, "x"), (-6, "x"), (-6, "x")], "id long, outcome string"))
    out, bad = W.apply_batch(q, batch, ["outcome"])
    return out.groupBy(F.coalesce("outcome", F.lit("pending")).alias("state")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.col("problem").alias("state")).agg(F.count("*").alias("n")))


BATCH_APPLY = """WITH q AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'done' END AS outcome FROM labels), p AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM q WHERE outcome IS NULL
), k AS (SELECT (SELECT count(*) FROM p WHERE n <= 10 OR n = 30) + (SELECT least(count(*), 3) FROM q WHERE outcome = 'done') + 3 AS size
), ok AS (SELECT id FROM p, k WHERE (n <= 10 OR n = 30) AND n <= size)
SELECT coalesce(CASE WHEN ok.id IS NOT NULL THEN 'reviewed' ELSE outcome END, 'pending') AS state, count(*) AS n FROM q LEFT JOIN ok USING (id) GROUP BY 1
UNION ALL SELECT 'not_next_in_order', count(*) FROM p, k WHERE (n <= 10 OR n = 30) AND n > size HAVING count(*) > 0 UNION ALL SELECT 'already_done', least(count(*), 3) FROM q WHERE outcome = 'done' HAVING count(*) > 0 UNION ALL SELECT 'unknown_id', 1 UNION ALL SELECT 'repeated_id', 2"""


def reaudit_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations' first questions as revised rows; reports that fit are applied, the others say why not."""
    t = _turns(spark, sf)
    i = F.col("id") % 8
    rows = t.select("id", F.when(i == 1, "keep").otherwise("revise").alias("outcome"), F.col("norm").alias("question"), F.concat("norm", F.lit(" b")).alias("final_question"), F.when(i == 2, "clear").alias("reaudit_status"), F.lit(None).cast("string").alias("reaudit_sha256"))
    payload = F.concat(F.lit("report "), F.col("id").cast("string"))
    reports = t.select((F.col("id") + F.when(i == 3, 5_000_000).otherwise(0)).alias("id"), F.when(i == 5, "other").otherwise(F.concat(F.lit(" "), "norm")).alias("question"), F.concat("norm", F.lit("  b")).alias("final_question"), F.when(i == 6, "needs_review").otherwise("clear").alias("decision"), payload.alias("payload"), F.when(i == 4, "0").otherwise(F.sha2(payload, 256)).alias("sha256"))
    out, bad = W.apply_reaudit(rows, reports)
    done = out.where("reaudit_sha256 IS NOT NULL").select("id", F.substring("reaudit_sha256", 1, 16).alias("result"))
    return done.unionByName(bad.select("id", F.col("problem").alias("result")))


REAUDIT_APPLY = "WITH " + _TURNS + """ SELECT id + CASE WHEN id % 8 = 3 THEN 5000000 ELSE 0 END AS id, CASE id % 8 WHEN 1 THEN 'not_revised' WHEN 2 THEN 'already_audited' WHEN 3 THEN 'unknown_id' WHEN 4 THEN 'digest_differs' WHEN 5 THEN 'question_differs' WHEN 6 THEN 'not_clear' ELSE left(sha256('report ' || id), 16) END AS result FROM turns"""


def judge_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """A judge's answer for each customer, some broken in one way or another, with the errors found in it."""
    good = '{"winner": "A", "answer_a": %s, "answer_b": %s, "rationale": "because"}'
    part = '{"evidence_support": 3, "safety_boundary": 1, "refusal_correctness": 2, "unsupported_claim": false, "unsafe_suggestion": true, "under_refusal": false}'
    bad = part.replace(": 3", ": 4").replace("false", '"no"', 1)
    texts = [good % (part, part), "```json\n" + good % (part, part) + "\n```", good % (bad, part), good % (part, '"none"'), good.replace('"A"', '"C"').replace('"because"', '" "') % (part, part), "[1, 2]", "{broken", "", " "]
    k = (F.col("c_custkey") % 10).cast("int")
    raw = F.element_at(F.array(*map(F.lit, texts)), F.least(k, F.lit(8)) + 1)
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.when(k == 8, "dry_run_not_executed").when(k == 9, F.lit(None).cast("string")).otherwise("success").alias("status"), raw.alias("raw_output"))
    return W.judge_errors(c).select("row_id", "status", "valid", "skipped", F.array_join("errors", ",").alias("errors"))


JUDGE_OUTPUTS = """SELECT c_custkey AS row_id, CASE WHEN k = 8 THEN 'dry_run_not_executed' WHEN k = 9 THEN 'unknown' ELSE 'success' END AS status, k <= 1 AS valid, k = 8 AS skipped,
  CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'answer_a.evidence_support_not_int_1_to_3,answer_a.unsupported_claim_not_bool' WHEN 3 THEN 'answer_b_missing_or_not_object' WHEN 4 THEN 'winner_invalid,rationale_missing_or_not_string' WHEN 5 THEN 'parse_error' WHEN 6 THEN 'json_decode_error' WHEN 8 THEN 'dry_run_empty_output_skipped' ELSE 'empty_output' END AS errors
FROM (SELECT c_custkey, c_custkey % 10 AS k FROM customer)"""


def over_budget(spark: SparkSession, sf: str) -> DataFrame:
    plan = V.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"))
    return W.over_budget(plan, {"calls": 10, "input_tokens": 1e12, "output_tokens": 100})


OVER_BUDGET = "SELECT * FROM (SELECT 'calls' AS name, CAST(count(*) AS DOUBLE) AS actual, 10.0::DOUBLE AS maximum FROM lineitem UNION ALL SELECT 'input_tokens', CAST(sum(l_quantity) AS DOUBLE), 1e12 FROM lineitem UNION ALL SELECT 'output_tokens', CAST(sum(l_linenumber) AS DOUBLE), 100 FROM lineitem) WHERE actual > maximum"


def method_matrix(spark: SparkSession, sf: str) -> DataFrame:
    plan = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.concat(F.lit("m"), F.least("l_linenumber", F.lit(4))).alias("method_id"))
    return W.method_matrix(plan, ("m1", "m2", "m3"))


METHOD_MATRIX = "SELECT * FROM (SELECT s AS sample_id, CAST(3 - count(*) FILTER (m IN ('m1', 'm2', 'm3')) AS INTEGER) AS missing, CAST(count(*) FILTER (m NOT IN ('m1', 'm2', 'm3')) AS INTEGER) AS unexpected, count(*) FILTER (n > 1) AS repeated FROM (SELECT l_orderkey AS s, 'm' || least(l_linenumber, 4) AS m, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY s) WHERE missing + unexpected + repeated > 0"


def frozen_drift(spark: SparkSession, sf: str) -> DataFrame:
    settings = V.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_regionkey").alias("value"))
    return W.frozen_drift(settings, {**{f"n{k}": "1" for k in range(25)}, "never": "x"})


FROZEN_DRIFT = "SELECT 'n' || n_nationkey AS name, '1' AS expected, CAST(n_regionkey AS VARCHAR) AS actual FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'never', 'x', NULL"


def usage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a zero ledger, but for some whose ledger counts tokens or is missing."""
    o = W.with_usage(V.table(spark, sf, "orders").select("o_orderkey"))
    k = F.col("o_orderkey") % 1000
    spent = F.struct(F.lit(0).cast("long").alias("external_model_calls"), F.lit(5).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(0.0).alias("estimated_cost"))
    o = o.withColumn("usage", F.when(k == 0, spent).when(k == 1, F.lit(None)).otherwise(F.col("usage")))
    return W.used(o).select("o_orderkey")


USAGE_LEDGER = "SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 IN (0, 1)"


def sample_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", F.col("user_id").alias("sample_id"))
    return W.sample_limit(e, 10, "event_id")


SAMPLE_LIMIT = "SELECT event_id, user_id AS sample_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id), user_id LIMIT 10)"


def confidence_order(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "low").otherwise("high")).when(F.col("toxic") == 1, "none").otherwise("medium").alias("confidence"))
    return W.by_confidence(d, order="doc_id")


CONFIDENCE_ORDER = "SELECT *, CAST(row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END, doc_id) AS INTEGER) AS review_place FROM (SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'low' ELSE 'high' END WHEN toxic = 1 THEN 'none' ELSE 'medium' END AS confidence FROM labels)"


def preselect(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).select(F.col("source_file").alias("source_id"), F.col("doc_id").alias("id"), "page_number", F.element_at(F.array(F.lit(128), F.lit(512), F.lit(1024)), (F.col("doc_id") % 3 + 1).cast("int")).alias("granularity"), F.length("content").alias("length"), F.array("lang", F.lit("en")).alias("topics"))
    return W.preselect(c, ("de", "fr", "en"), 5).select("source_id", "id", "place")


PRESELECT = "WITH " + V.CHUNKS + " SELECT source_file AS source_id, doc_id AS id, CAST(row_number() OVER (PARTITION BY source_file ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, abs([128, 512, 1024][CAST(doc_id % 3 + 1 AS INTEGER)] - 512), abs(length(content) - 600), page_number, doc_id) AS INTEGER) AS place FROM chunks QUALIFY place <= 5"


def config_winner(spark: SparkSession, sf: str) -> DataFrame:
    s = E.method_summary(E.retrieval_metrics(V.routed(spark, sf), V.gold(spark, sf)))
    return W.config_winner(s, ("strict_hit", "mrr", "source_hit", "-page_precision", "-queries")).select("method_id")


CONFIG_WINNER = "WITH " + _METRICS + " SELECT method_id FROM (SELECT method_id, avg(strict_hit) AS a, avg(mrr) AS b, avg(source_hit) AS c, avg(page_precision) AS d, count(*) AS n FROM metrics GROUP BY method_id) ORDER BY a DESC, b DESC, c DESC, d, n, method_id LIMIT 1"


def merged_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers as pools: the keys of both, which a merge must not have."""
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return W.merge_pools(s, V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")[1]


MERGED_POOL = "SELECT id, count(*) AS rows FROM (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT c_custkey FROM customer) GROUP BY id HAVING count(*) > 1"


def selection_audit(spark: SparkSession, sf: str) -> DataFrame:
    """First questions split by the parity of their conversation, with rules broken on purpose."""
    t = write_once(_turns(spark, sf), "turns")
    split = t.select("id", F.when(F.col("id") % 2 == 0, "validation").otherwise("pilot_test").alias("dataset_split"), F.when(F.col("id") % 5 == 0, "boundary").otherwise("answer").alias("decision"), "norm", (F.col("id") % 25).alias("fact_cluster"), F.floor(F.col("id") / 2).alias("anchor_group"))
    split = split.unionByName(split.where("id % 20 = 0").withColumn("id", F.col("id") + 500_000))
    pool = split.where("id % 7 <> 0").withColumn("decision", F.when(F.col("id") % 11 == 0, "review").otherwise(F.col("decision")))
    dev = t.where("id % 9 = 0").select("id", (F.col("id") % 25).alias("fact_cluster"))
    out = W.selection_violations(split, pool, t.where("id % 13 = 0"), {"validation": {"answer": 30, "boundary": 1}, "final": {"answer": 1}}, ["decision", "norm"], ["fact_cluster", "anchor_group"], 0.65, dev)
    return out.groupBy("violation").agg(F.count("*").alias("n"))


SELECTION_AUDIT = "WITH " + _TURNS + f""", s0 AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'validation' ELSE 'pilot_test' END AS sp, CASE WHEN id % 5 = 0 THEN 'boundary' ELSE 'answer' END AS d, norm, id % 25 AS fc, id // 2 AS ag FROM turns
), s AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT id + 500000, sp, d, norm, fc, ag FROM s0 WHERE id % 20 = 0), dev AS (SELECT id, id % 25 AS fc FROM turns WHERE id % 9 = 0
), w(sp, d, k) AS (VALUES ('validation', 'answer', 30), ('validation', 'boundary', 1), ('final', 'answer', 1)), c AS (SELECT sp, d, count(*) AS n FROM s GROUP BY ALL
), g AS MATERIALIZED (SELECT id, sp, {_GRAMS.format('norm')} AS g FROM s
), v AS (
  SELECT 'not_in_pool' AS violation, count(*) AS n FROM s WHERE id % 7 = 0
  UNION ALL SELECT 'quarantined', count(*) FROM s WHERE id IN (SELECT id FROM turns WHERE id % 13 = 0)
  UNION ALL SELECT 'label_drift', count(*) FROM s WHERE id % 7 <> 0 AND id % 11 = 0
  UNION ALL SELECT 'decision_drift', count(*) FROM w FULL JOIN c ON w.sp = c.sp AND w.d = c.d WHERE coalesce(w.k, 0) <> coalesce(c.n, 0)
  UNION ALL SELECT 'shared_fact_cluster', count(*) FROM (SELECT fc FROM s GROUP BY fc HAVING count(DISTINCT sp) > 1) UNION ALL SELECT 'shared_anchor_group', count(*) FROM (SELECT ag FROM s GROUP BY ag HAVING count(DISTINCT sp) > 1)
  UNION ALL SELECT 'dev_fact_cluster', count(DISTINCT fc) FROM s WHERE fc IN (SELECT fc FROM dev)
  UNION ALL SELECT 'near_duplicate_across', count(*) FROM g a JOIN g b ON a.id < b.id AND a.sp <> b.sp AND len(a.g) > 0 AND len(b.g) > 0 WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.65
  UNION ALL SELECT 'dev_id', count(*) FROM s WHERE id IN (SELECT id FROM dev))
SELECT * FROM v WHERE n > 0"""


def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    paths = write_once(Q.paths(spark, sf), "all-paths")
    return G.coverage_audit(V.questions(spark, sf), V.query_constraints(spark, sf), Q._candidates(spark, sf), V.constraints(spark, sf), paths)


_SIGNED = _PATHS + """, sig AS MATERIALIZED (SELECT query_id, candidate_key, string_agg(DISTINCT ctype, '+' ORDER BY ctype) AS signature FROM m GROUP BY ALL)"""
COVERAGE_AUDIT = "WITH " + _SIGNED + """, asked AS (SELECT query_id, count(*) AS cc, count(DISTINCT ctype) AS ct, bool_or(ctype = 'clinical_condition') AS qcond, count(DISTINCT ctype) FILTER (EXISTS (SELECT 1 FROM xc WHERE xc.ctype = qc.ctype AND xc.cvalue = qc.cvalue)) AS posted FROM qc GROUP BY query_id
), named AS (SELECT DISTINCT owner_id FROM xc WHERE ctype = 'clinical_condition'
), met AS (SELECT query_id, count(*) AS met, count(*) FILTER (candidate_key IN (SELECT owner_id FROM named)) AS mn, max(type_count) AS most, count(*) FILTER (reason = 'qualified') AS good, count(DISTINCT source_file) FILTER (reason = 'qualified') AS src FROM paths GROUP BY query_id
), b AS (SELECT q.query_id, coalesce(cc, 0) AS cc, coalesce(ct, 0) AS ct, coalesce(qcond, false) AS qcond, coalesce(posted, 0) AS posted, coalesce(met, 0) AS met, coalesce(mn, 0) AS mn, coalesce(most, 0) AS most, coalesce(good, 0) AS good, coalesce(src, 0) AS src, (SELECT count(*) FROM chunks) AS total, (SELECT count(*) FROM named) AS all_named FROM questions q LEFT JOIN asked USING (query_id) LEFT JOIN met USING (query_id)
), fl AS (SELECT query_id, reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT query_id, reason, count(*) AS n FROM paths WHERE reason <> 'qualified' GROUP BY ALL UNION ALL SELECT query_id, 'condition_conflict', CASE WHEN qcond THEN all_named - mn ELSE 0 END FROM b UNION ALL SELECT query_id, 'insufficient_types', total - met - CASE WHEN qcond THEN all_named - mn ELSE 0 END FROM b) GROUP BY ALL HAVING sum(n) > 0
), tops AS (SELECT query_id, string_agg(reason || ':' || n, ',' ORDER BY n DESC, reason) FILTER (r <= 5) AS top, bool_or(reason = 'no_content_supported_match') AS nc, bool_or(reason = 'broad_content_only') AS br FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, reason) AS r FROM fl) GROUP BY query_id
), sg AS (SELECT query_id, string_agg(signature || ':' || n, ',' ORDER BY signature) AS sigs FROM (SELECT p.query_id, signature, count(*) AS n FROM paths p JOIN sig s ON s.query_id = p.query_id AND s.candidate_key = p.candidate_key WHERE reason = 'qualified' GROUP BY ALL) GROUP BY query_id
), z AS (SELECT b.*, coalesce(sigs, '') AS sigs, coalesce(top, '') AS top, CASE WHEN cc = 0 THEN 'zero_query_constraints' WHEN ct < 2 THEN 'insufficient_query_types' WHEN good > 0 THEN 'not_applicable' WHEN coalesce(nc, false) THEN 'no_content_supported_match' WHEN coalesce(br, false) THEN 'broad_content_only' ELSE 'no_posting' END AS zr FROM b LEFT JOIN tops USING (query_id) LEFT JOIN sg USING (query_id))
SELECT query_id, cc AS constraint_count, ct AS constraint_type_count, good AS potential_path_count, src AS candidate_source_count, most AS most_types, sigs AS signatures, top AS top_failures, zr AS zero_path_reason,
  CASE WHEN zr = 'no_posting' THEN CASE WHEN posted < 2 THEN 'insufficient_posting_types' WHEN most < 2 THEN 'no_candidate_cooccurrence' ELSE 'path_policy_filtered' END WHEN zr IN ('no_content_supported_match', 'broad_content_only') THEN 'path_policy_filtered' ELSE zr END AS zero_path_diagnosis FROM z"""


def routing_audit(spark: SparkSession, sf: str) -> DataFrame:
    return A.routing_audit(V.questions(spark, sf), G.route_with_quotas(Q._qualified(spark, sf), 6, 2, 1), 2, 1)


ROUTING_AUDIT = "WITH " + _ROUTE + """, rt AS (SELECT r.*, c.source_file FROM route r JOIN chunks c USING (candidate_key)
), t AS (SELECT query_id, string_agg(tier || ':' || n, ',' ORDER BY tier) AS tiers FROM (SELECT query_id, tier, count(*) AS n FROM rt WHERE route_decision = 'selected' GROUP BY ALL) GROUP BY ALL
), dr AS (SELECT query_id, string_agg(route_decision || ':' || n, ',' ORDER BY route_decision) AS drops FROM (SELECT query_id, route_decision, count(*) AS n FROM rt WHERE route_decision <> 'selected' GROUP BY ALL) GROUP BY ALL
), rc AS (SELECT query_id, count(*) AS raw, count(*) FILTER (route_decision = 'selected') AS routed, count(DISTINCT source_file) FILTER (route_decision = 'selected') AS src FROM rt GROUP BY ALL)
SELECT query_id, coalesce(raw, 0) AS raw_path_count, coalesce(routed, 0) AS routed_path_count, coalesce(src, 0) AS candidate_source_count, coalesce(tiers, '') AS tiers, coalesce(drops, '') AS drops, CAST(0 AS BIGINT) AS source_violations, CAST(0 AS BIGINT) AS source_page_violations
FROM questions LEFT JOIN rc USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN dr USING (query_id)"""


def trace_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Selected paths as stored traces, some of them tampered with, against a rebuild."""
    paths = write_once(Q.paths(spark, sf), "all-paths")
    t = G.select_with_quotas(paths.where("reason = 'qualified'"), 6, 2, 1).select("query_id", "candidate_key", "source_file", "page_number", "tier", "signature", "route_rank")
    k = F.pmod(F.col("query_id") + F.col("route_rank"), F.lit(7))
    t = t.withColumn("candidate_key", F.when(k == 0, F.concat("candidate_key", F.lit("x"))).otherwise(F.col("candidate_key"))).withColumn("page_number", F.when(k == 1, F.col("page_number") + 1).otherwise(F.col("page_number"))).withColumn("signature", F.when(k == 2, F.concat(F.lit("age_group+"), "signature")).otherwise(F.col("signature"))).withColumn("tier", F.when(k == 3, F.col("tier") + 1).otherwise(F.col("tier"))).withColumn("route_rank", F.when(k == 4, 0).otherwise(F.col("route_rank")))
    return G.trace_failures(t, paths)


TRACE_FAILURES = "WITH " + _ROUTE + """ SELECT query_id, candidate_key || CASE WHEN k = 0 THEN 'x' ELSE '' END AS candidate_key, CASE k WHEN 0 THEN 'not_in_index' WHEN 1 THEN 'identity' WHEN 2 THEN 'constraint_types' WHEN 3 THEN 'source_tier' ELSE 'route_rank' END AS failure
FROM (SELECT query_id, candidate_key, (query_id + route_rank) % 7 AS k FROM route WHERE route_decision = 'selected') WHERE k <= 4"""


def contiguous_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as ranks; those of returned lines are one too high."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") + (F.col("l_returnflag") == "A").cast("int")).alias("rank"))
    return A.contiguous_ranks(li, ["l_orderkey"], "rank")


CONTIGUOUS_RANKS = "SELECT l_orderkey, count(*) AS rows, min(r) = 1 AND max(r) = count(*) AND count(DISTINCT r) = count(*) AS contiguous FROM (SELECT l_orderkey, l_linenumber + (l_returnflag = 'A')::INT AS r FROM lineitem) GROUP BY l_orderkey"


def grown_pool(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf).select("query_id", "method_id", "candidate_key", "rank")
    return G.grow_pool(r.where("method_id = 'sparse'"), r.where("method_id = 'dense'"), 10, 24).select("query_id", "candidate_key", "pool_rank")


GROWN_POOL = "WITH " + V.ROUTED + """, p AS (SELECT query_id, candidate_key, 0 AS part, rank FROM routed WHERE method_id = 'sparse' AND rank <= 10 UNION ALL SELECT query_id, candidate_key, 1, rank FROM routed WHERE method_id = 'dense'
), f AS (SELECT query_id, candidate_key, min((part, rank)) AS pl FROM p GROUP BY ALL) SELECT query_id, candidate_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pl, candidate_key) AS INTEGER) AS pool_rank FROM f QUALIFY pool_rank <= 24"""


def late_union(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf).select("query_id", "method_id", "candidate_key", F.col("raw_score").alias("reranker_score"), F.round(1 / (60 + F.col("rank")), 9).alias("rrf_score"))
    return G.late_union(r.where("method_id = 'sparse'"), r.where("method_id = 'dense'"), 24).select("query_id", "candidate_key", "post_rerank_rank")


LATE_UNION = "WITH " + V.ROUTED + """, r AS (SELECT query_id, method_id, candidate_key, raw_score AS s, round(1.0::DOUBLE / (60 + rank), 9) AS f FROM routed), u AS (SELECT * FROM r WHERE method_id = 'sparse' UNION ALL SELECT * FROM r a WHERE method_id = 'dense' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.method_id = 'sparse' AND b.query_id = a.query_id AND b.candidate_key = a.candidate_key))
SELECT query_id, candidate_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, f DESC, candidate_key) AS INTEGER) AS post_rerank_rank FROM u QUALIFY post_rerank_rank <= 24"""


def pool_differences(spark: SparkSession, sf: str) -> DataFrame:
    """A pool and its reordering, in which some questions' first candidate has another page or stands twice."""
    before = V.routed(spark, sf).where("method_id = 'sparse'").select("query_id", "candidate_key", "source_file", "page_number", "rank")
    k = F.col("query_id") % 4
    after = before.withColumn("page_number", F.when((k == 1) & (F.col("rank") == 1), F.col("page_number") + 1).otherwise(F.col("page_number")))
    after = after.unionByName(after.where((k == 2) & (F.col("rank") == 1)))
    return G.pool_differences(before, after, ["candidate_key", "source_file", "page_number"])


POOL_DIFFERENCES = "WITH " + V.ROUTED + " SELECT query_id, CAST(CASE WHEN query_id % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS repeated, CAST(CASE WHEN query_id % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS only_before, CAST(CASE WHEN query_id % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS only_after FROM (SELECT DISTINCT query_id FROM routed WHERE method_id = 'sparse') WHERE query_id % 4 IN (1, 2)"


def context_of_page(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).select(F.col("doc_id").alias("id"), F.col("source_file").alias("source_id"), F.floor(F.col("page_number") / 4).alias("page_number"), F.lit(512).alias("granularity"), F.col("content").alias("text"))
    return AN.context_of_page(c)


CONTEXT_OF_PAGE = "WITH " + V.CHUNKS + " SELECT doc_id AS id, first_value(doc_id) OVER (PARTITION BY source_file, page_number // 4 ORDER BY length(" + _WS.format("content") + ") DESC, doc_id DESC) AS context_id FROM chunks"


def rank_changes(spark: SparkSession, sf: str) -> DataFrame:
    r = V.routed(spark, sf)
    return E.rank_changes(r.where("method_id = 'dense'"), r.where("method_id = 'sparse'"))


RANK_CHANGES = "WITH " + V.ROUTED + """ SELECT coalesce(b.query_id, a.query_id) AS query_id, coalesce(b.candidate_key, a.candidate_key) AS candidate_key, b.rank AS rank_before, a.rank AS rank_after, b.rank - a.rank AS rank_delta, CASE WHEN b.rank IS NULL THEN 'added' WHEN a.rank IS NULL THEN 'removed' WHEN a.rank = b.rank THEN 'same' ELSE 'moved' END AS membership
FROM (SELECT * FROM routed WHERE method_id = 'dense') b FULL JOIN (SELECT * FROM routed WHERE method_id = 'sparse') a ON a.query_id = b.query_id AND a.candidate_key = b.candidate_key"""


def strict_effects(spark: SparkSession, sf: str) -> DataFrame:
    """What the sparse route does to the dense route's gold pages."""
    g = V.gold(spark, sf)
    hits = E.first_hits(V.routed(spark, sf), g)
    side = lambda m: g.select("query_id").join(hits.where(F.col("method_id") == m).select("query_id", "strict_rank"), "query_id", "left")
    out = E.strict_effects(side("dense"), side("sparse"))
    return out.select("query_id", "effect", F.round("mrr_delta", 6).alias("mrr_delta"), "direction")


STRICT_EFFECTS = "WITH " + V.ROUTED + """, h AS (SELECT g.query_id, min(r.rank) FILTER (r.method_id = 'dense') AS b, min(r.rank) FILTER (r.method_id = 'sparse') AS a FROM gold g LEFT JOIN routed r ON r.query_id = g.query_id AND lower(replace(r.source_file, ' ', '')) = lower(replace(g.source_file, ' ', '')) AND r.page_number = g.page_number GROUP BY g.query_id)
SELECT query_id, CASE WHEN b IS NULL AND a IS NOT NULL THEN 'strict_hit_added' WHEN b IS NOT NULL AND a IS NULL THEN 'strict_hit_lost' WHEN a < b THEN 'strict_rank_improved' WHEN a > b THEN 'strict_rank_worsened' ELSE 'strict_metric_unchanged' END AS effect,
  round(coalesce(1.0::DOUBLE / a, 0) - coalesce(1.0::DOUBLE / b, 0), 6) AS mrr_delta, CASE WHEN coalesce(1.0::DOUBLE / a, 0) - coalesce(1.0::DOUBLE / b, 0) > 1e-12 THEN 'positive' WHEN coalesce(1.0::DOUBLE / a, 0) - coalesce(1.0::DOUBLE / b, 0) < -1e-12 THEN 'negative' ELSE 'zero' END AS direction FROM h"""


def budget_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """Gold pages that the graph's share of the budget gained or lost, in the expanded pool and its first four."""
    selected = Q._selected(spark, sf)
    after = write_once(Q._expanded(spark, sf, selected), "expanded")
    where = V.chunks(spark, sf).select("candidate_key", "source_file", "page_number")
    placed = lambda df: df.join(where, "candidate_key")
    evidence = Q._moved(spark, sf, after, selected).where("new_rank <= 4").select("query_id", "candidate_key")
    return E.budget_replacement(placed(Q._fused(spark, sf).select("query_id", "candidate_key", "rank")), placed(after.select("query_id", "candidate_key")), placed(evidence), V.gold(spark, sf), 18)


BUDGET_REPLACEMENT = GRAPH_RERANK.rpartition("SELECT e.query_id, e.candidate_key, origin")[0] + """, rr AS (SELECT e.query_id, e.candidate_key, row_number() OVER (PARTITION BY e.query_id ORDER BY expanded_rank - 2.0::DOUBLE * coalesce(p, 0), expanded_rank, e.candidate_key) AS nr FROM expanded e LEFT JOIN ps ON ps.query_id = e.query_id AND ps.candidate_key = e.candidate_key
), x AS (SELECT g.query_id, bool_or(f.candidate_key IS NOT NULL) AS bh, bool_or(e.candidate_key IS NOT NULL) AS ah, bool_or(coalesce(rr.nr <= 4, false)) AS eh, bool_or(coalesce(rr.nr <= 4, false) AND f.candidate_key IS NULL) AS ng, min(f.rank) FILTER (e.candidate_key IS NULL) AS gone
  FROM gold g JOIN chunks c ON lower(c.source_file) = lower(g.source_file) AND c.page_number = g.page_number LEFT JOIN fused f ON f.query_id = g.query_id AND f.candidate_key = c.candidate_key LEFT JOIN expanded e ON e.query_id = g.query_id AND e.candidate_key = c.candidate_key LEFT JOIN rr ON rr.query_id = g.query_id AND rr.candidate_key = c.candidate_key GROUP BY g.query_id)
SELECT query_id, CASE WHEN bh AND ah THEN 'both' WHEN bh THEN 'lost' WHEN ah THEN 'added' ELSE 'neither' END AS outcome, CASE WHEN bh AND NOT ah THEN CASE WHEN gone <= 18 THEN 'pre_rerank_budget_replacement' ELSE 'unresolved' END END AS loss_mechanism,
  CASE WHEN eh THEN CASE WHEN ng THEN 'graph_added_gold_selected' WHEN bh AND ah THEN 'baseline_gold_promoted_after_replacement' ELSE 'other' END END AS gain_attribution, CAST(gone AS INTEGER) AS removed_best_rank FROM x"""


def _window(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of the sparse route, each with its best neighbour by the number of the page, the first four rows a question."""
    seeds = V.routed(spark, sf).where("method_id = 'sparse' AND rank <= 4").select("query_id", "source_file", "page_number", "candidate_key", F.col("rank").alias("seed_rank"))
    seeds = write_once(seeds, "seeds")
    near = R.neighbour_pages(seeds.drop("candidate_key"), V.chunks(spark, sf).select("source_file", "page_number", "candidate_key"), 1).withColumn("overlap", F.col("page_number") % 3)
    return R.evidence_window(seeds, near, 4, 1)


def evidence_window(spark: SparkSession, sf: str) -> DataFrame:
    return _window(spark, sf).select("query_id", "candidate_key", "position", "is_neighbor")


_WINDOW = NEIGHBOUR_PAGES.partition("WITH ")[2].rpartition("SELECT s.query_id, c.source_file")[0] + """, nb AS (SELECT s.query_id, c.source_file, c.page_number, c.candidate_key, s.seed_rank, c.page_number - s.page_number AS off FROM s JOIN chunks c ON c.source_file = s.source_file AND abs(c.page_number - s.page_number) = 1
  WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = s.query_id AND z.source_file = c.source_file AND z.page_number = c.page_number) QUALIFY row_number() OVER (PARTITION BY s.query_id, c.source_file, c.page_number ORDER BY s.seed_rank, c.page_number - s.page_number, c.candidate_key) = 1
), one AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY query_id, seed_rank ORDER BY page_number % 3 DESC, abs(off), off) = 1
), win AS MATERIALIZED (SELECT query_id, source_file, page_number, candidate_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, n) AS INTEGER) AS position, n > 0 AS is_neighbor FROM (
  SELECT query_id, source_file, page_number, candidate_key, rank AS seed_rank, 0 AS n FROM routed WHERE method_id = 'sparse' AND rank <= 4 UNION ALL SELECT query_id, source_file, page_number, candidate_key, seed_rank, 1 FROM one) QUALIFY position <= 4)"""
EVIDENCE_WINDOW = "WITH " + _WINDOW + " SELECT query_id, candidate_key, position, is_neighbor FROM win"


def recovery_metrics(spark: SparkSession, sf: str) -> DataFrame:
    w = write_once(_window(spark, sf), "windows")
    status = w.groupBy("query_id").agg(F.when(F.count_if("is_neighbor") == 0, "insufficient_evidence").otherwise("success").alias("retrieval_status"))
    rows, _ = E.recovery_metrics(w.withColumnRenamed("position", "rank"), status, V.gold(spark, sf))
    return rows.select("query_id", "retrieval_status", "source_hit", "strict_hit", "adjacent_hit", "strict_rank", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


RECOVERY_METRICS = "WITH " + _WINDOW + """, h AS (SELECT g.query_id, min(position) FILTER (own) AS sr, min(position) FILTER (own AND d = 0) AS pr, min(position) FILTER (own AND d <= 1) AS ar, count(*) FILTER (is_neighbor) AS nn, count(candidate_key) AS n
  FROM (SELECT g.query_id, w.position, w.candidate_key, w.is_neighbor, lower(replace(w.source_file, ' ', '')) = lower(replace(g.source_file, ' ', '')) AS own, abs(w.page_number - g.page_number) AS d FROM gold g LEFT JOIN win w USING (query_id)) g GROUP BY g.query_id)
SELECT query_id, CASE WHEN n = 0 THEN NULL WHEN nn = 0 THEN 'insufficient_evidence' ELSE 'success' END AS retrieval_status, sr IS NOT NULL AS source_hit, pr IS NOT NULL AS strict_hit, ar IS NOT NULL AS adjacent_hit, pr AS strict_rank, round(coalesce(1.0::DOUBLE / pr, 0), 6) AS reciprocal_rank FROM h"""


def method_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Both routes at twenty candidates and four pieces of evidence, with made-up latencies for most questions."""
    r = V.routed(spark, sf).select("query_id", "method_id", "rank", "source_file", "page_number")
    took = r.where("rank = 1 AND query_id % 5 <> 0").select("query_id", "method_id", (F.length("method_id") + F.col("query_id") % 3).alias("seconds"))
    out = E.method_evaluation(r, r.where("rank <= 4"), V.gold(spark, sf), took)
    return out.select("method_id", "queries", *[F.round(c, 6).alias(c) for c in ("candidate_source", "candidate_strict", "candidate_mrr", "final_source", "final_strict", "final_adjacent", "mean_candidates", "mean_evidence", "mean_seconds")])


METHOD_EVALUATION = "WITH " + V.ROUTED + """, h AS (SELECT r.query_id, r.method_id, rank, lower(replace(r.source_file, ' ', '')) = lower(replace(g.source_file, ' ', '')) AS own, abs(r.page_number - g.page_number) AS d FROM routed r JOIN gold g ON g.query_id = r.query_id
), m AS (SELECT g.query_id, x.method_id, coalesce(bool_or(own), false) AS cs, coalesce(bool_or(own AND d = 0), false) AS cp, coalesce(1.0::DOUBLE / min(rank) FILTER (own AND d = 0), 0) AS rr, coalesce(bool_or(own AND rank <= 4), false) AS fs, coalesce(bool_or(own AND d = 0 AND rank <= 4), false) AS fp, coalesce(bool_or(own AND d <= 1 AND rank <= 4), false) AS fa, count(rank) AS n, count(rank) FILTER (rank <= 4) AS n4
  FROM gold g CROSS JOIN (SELECT DISTINCT method_id FROM routed) x LEFT JOIN h ON h.query_id = g.query_id AND h.method_id = x.method_id GROUP BY ALL)
SELECT method_id, count(*) AS queries, round(avg(cs::INT), 6) AS candidate_source, round(avg(cp::INT), 6) AS candidate_strict, round(avg(rr), 6) AS candidate_mrr, round(avg(fs::INT), 6) AS final_source, round(avg(fp::INT), 6) AS final_strict, round(avg(fa::INT), 6) AS final_adjacent,
  round(sum(n) / count(*) FILTER (n > 0), 6) AS mean_candidates, round(sum(n4) / count(*) FILTER (n4 > 0), 6) AS mean_evidence, round(avg(length(method_id) + query_id % 3) FILTER (n > 0 AND query_id % 5 <> 0), 6) AS mean_seconds FROM m GROUP BY method_id"""


def rerank_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Per question, whether coverage reranking applied and what it moved."""
    r = Q._covered(spark, sf).select("query_id", "candidate_key", "rank", "new_rank", F.col("rerank_status").alias("status"))
    return A.rerank_runs(r, spark.createDataFrame([], "query_id long, status string"), 4)[0]


RERANK_RUNS = COVERAGE_RERANK.rpartition("SELECT query_id, candidate_key, round(coverage, 6)")[0] + """, nr AS (SELECT query_id, candidate_key, rank, rerank_status, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_status = 'applied' THEN -gs ELSE 0 END, rank, candidate_key) AS new_rank FROM s)
SELECT query_id, any_value(rerank_status) AS status, CASE WHEN any_value(rerank_status) = 'applied' THEN arg_min(candidate_key, rank) <> arg_min(candidate_key, new_rank) END AS top1_changed, count(*) FILTER (new_rank <= 4 AND rank > 4) AS moved_in, count(*) FILTER (new_rank > 4 AND rank <= 4) AS moved_out FROM nr GROUP BY query_id"""


def rerank_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = Q._covered(spark, sf).select("query_id", "candidate_key", "rank", "new_rank", F.col("rerank_status").alias("status"))
    return A.rerank_runs(r, Q.constraint_audit(spark, sf), 4)[1]


RERANK_TOTALS = "SELECT count(*) AS queries, count(*) FILTER (status = 'applied') AS applicable, count(*) FILTER (status <> 'applied') AS not_applicable, count(*) FILTER (top1_changed) AS top1_changed, count(*) FILTER (NOT top1_changed) AS top1_unchanged, (SELECT count(*) FROM (" + CONSTRAINT_AUDIT + ") WHERE status = 'conflict') AS conflicts, (SELECT count(*) FROM (" + CONSTRAINT_AUDIT + ") WHERE status = 'unsupported') AS unsupported FROM (" + RERANK_RUNS + ")"


def manual_queue(spark: SparkSession, sf: str) -> DataFrame:
    top = Q._fused(spark, sf).where("rank <= 4").select("query_id", "rank", "candidate_key")
    # some questions need a review whatever their evidence, so that the queue is never empty
    actions = Q.route_actions(spark, sf).withColumn("route_action", F.when(F.col("query_id") % 5 == 0, "review_required").otherwise(F.col("route_action")))
    return A.manual_queue(actions, top)


MANUAL_QUEUE = "WITH " + _PAIRS + ", i AS (SELECT query_id, sha256(string_agg(candidate_key, '|' ORDER BY rank)) AS input_identity FROM fused WHERE rank <= 4 GROUP BY query_id) SELECT query_id, route_action, input_identity, 'pending_manual_adjudication' AS review_status FROM (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'review_required' ELSE route_action END AS route_action FROM (" + ROUTE_ACTIONS + ")) LEFT JOIN i USING (query_id) WHERE NOT starts_with(route_action, 'allow_')"


def evidence_view(spark: SparkSession, sf: str) -> DataFrame:
    """evidence as a user sees it."""
    e = V.evidence(spark, sf).where("method_id = 'sparse'")
    return R.evidence_view(e).select("query_id", "source", "page", "rank")


EVIDENCE_VIEW = "WITH " + V.ROUTED + " SELECT query_id, source_file AS source, page_number AS page, rank FROM routed WHERE method_id = 'sparse' AND rank <= 4"

_NAMES = (
    "prescription_boundary shortlist_relevance limited_sources scope_flags method_pairs challenge_candidates parent_overlap overlap_audit revision_reaudit review_selection decision_coverage author_batches batch_apply reaudit_apply judge_outputs over_budget method_matrix frozen_drift usage_ledger sample_limit confidence_order "
    "preselect config_winner merged_pool selection_audit coverage_audit routing_audit trace_failures contiguous_ranks grown_pool late_union pool_differences context_of_page rank_changes strict_effects budget_replacement evidence_window recovery_metrics method_evaluation rerank_runs rerank_totals manual_queue evidence_view"
).split()
QUERIES = {n: (globals()[n], globals()[n.upper()]) for n in _NAMES}
