"""Curation, contract and ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions import text as X
from evidrill.functions.rules import REFERENCE_HEADING, is_noise
from evidrill.operators import audits as A
from evidrill.operators import chunking, contracts as K, curation as C
from evidrill.queries import views as V
from evidrill.queries.retrieval import _GRAMS, _NORM
from evidrill.sources import files as S


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """First user turn of each conversation: the candidate questions of an evaluation set."""
    t = V.table(spark, sf, "conversations").where("role = 'user'")
    return t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).select(F.col("conv_id").alias("id"), X.norm_text("question").alias("norm"))


_TURNS = "turns AS (SELECT conv_id AS id, " + _NORM.format("coalesce(text, '')") + " AS norm FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id))"


def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of first questions at a trigram similarity of 0.65 or more, exactly; some questions come again, changed a little."""
    t = _turns(spark, sf)
    t = t.unionByName(t.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat("norm", F.lit("zqzq")).alias("norm")))
    return C.similar_texts(t, 0.65).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


NEAR_DUP_PAIRS = "WITH " + _TURNS + f""", t AS (SELECT id, norm FROM turns UNION ALL SELECT id + 1000000, norm || 'zqzq' FROM turns WHERE id % 10 = 0), g AS MATERIALIZED (SELECT id, {_GRAMS.format('norm')} AS g FROM t), p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.id < b.id AND len(a.g) > 0 AND len(b.g) > 0)
SELECT left_id, right_id, round(i / (s - i), 6) AS similarity FROM p WHERE i / (s - i) >= 0.65"""


def near_dup_best(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar benchmark passage of each question, at a similarity of 0.05 or more."""
    q = C.grams_of(_turns(spark, sf), "id", "norm")
    b = C.grams_of(V.questions(spark, sf).select("query_id", X.norm_text("query").alias("norm")), "query_id", "norm")
    return C.best_match(C.similar_pairs(q, b, 0.05))


NEAR_DUP_BEST = "WITH " + _TURNS + ", " + V.QUESTIONS + f""", a AS MATERIALIZED (SELECT id, {_GRAMS.format('norm')} AS g FROM turns), b AS MATERIALIZED (SELECT query_id, {_GRAMS.format('n')} AS g FROM (SELECT query_id, {_NORM.format('query')} AS n FROM questions)
), p AS (SELECT a.id AS left_id, b.query_id AS right_id, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM a, b WHERE len(a.g) > 0 AND len(b.g) > 0)
SELECT left_id, right_id, round(i / (s - i), 6) AS similarity FROM p WHERE i / (s - i) >= 0.05 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY i / (s - i) DESC, right_id) = 1"""


def canonical_dups(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).select("doc_id", F.sha2(X.norm_text("content"), 256).alias("digest"), "content")
    # a digest instead of whole texts is what the window sorts
    out = C.canonical_duplicates(c.select("doc_id", F.when(X.norm_text("content") == "", "").otherwise(F.col("digest")).alias("norm")), "doc_id", F.col("norm"))
    return out.select("doc_id", "canonical_id", "copies")


CANONICAL_DUPS = "WITH " + V.CHUNKS + f", n AS (SELECT doc_id, {_NORM.format('content')} AS t FROM chunks), k AS (SELECT doc_id, CASE WHEN t = '' THEN 'id' || doc_id ELSE t END AS k FROM n) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical_id, count(*) OVER (PARTITION BY k) AS copies FROM k"


def leakage_join(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as candidates against customers as the development set, by several criteria."""
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.floor("s_acctbal").cast("long").alias("bal"))
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").cast("long").alias("bal"))
    out = C.leakage_reasons(s, c, [("exact", ["id", "nation"]), ("balance", ["bal"]), ("nation_balance", ["nation", "bal"])])
    return out.select("id", F.array_join("reasons", ",").alias("reasons"))


LEAKAGE_JOIN = """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS nation, CAST(floor(s_acctbal) AS BIGINT) AS bal FROM supplier), c AS (SELECT c_custkey AS id, c_nationkey AS nation, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer)
SELECT id, array_to_string(list_filter([CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.id = s.id AND c.nation = s.nation) THEN 'exact' END, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.bal = s.bal) THEN 'balance' END, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.nation = s.nation AND c.bal = s.bal) THEN 'nation_balance' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"""


def two_pass_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("pass1_decision"), F.col("toxic").alias("pass2_decision"))
    out = C.compare_passes(rows, ["decision"])
    return out.select("doc_id", "agreed", F.array_join("disagreements", ",").alias("disagreements"))


TWO_PASS_AGREEMENT = "SELECT doc_id, quality IS NOT DISTINCT FROM toxic AS agreed, CASE WHEN quality IS DISTINCT FROM toxic THEN 'decision' ELSE '' END AS disagreements FROM labels"


def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.transitions(V.table(spark, sf, "labels"), "quality", "toxic")


TRANSITION_COUNTS = "SELECT coalesce(CAST(quality AS VARCHAR), '') || '->' || coalesce(CAST(toxic AS VARCHAR), '') AS transition, count(*) AS n FROM labels GROUP BY 1"


def resolution_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Disagreeing rows in a seeded order, in batches of 25."""
    rows = two_pass_agreement(spark, sf).where("NOT agreed")
    return C.in_batches(rows.select("doc_id", C.seeded_order("queue", "doc_id").alias("o")), [F.col("o"), F.col("doc_id")], 25).select("doc_id", "place", "batch")


RESOLUTION_QUEUE = "SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS place, CAST((row_number() OVER w - 1) // 25 + 1 AS INTEGER) AS batch FROM labels WHERE quality IS DISTINCT FROM toxic WINDOW w AS (ORDER BY sha256('queue|' || doc_id), doc_id)"


def sized_batches(spark: SparkSession, sf: str) -> DataFrame:
    n = V.table(spark, sf, "nation")
    return C.in_sized_batches(n, [F.col("n_regionkey"), F.col("n_nationkey")], (4, 6, 10)).select("n_nationkey", "place", "batch")


SIZED_BATCHES = "WITH p AS (SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INTEGER) AS place FROM nation) SELECT n_nationkey, place, CAST(CASE WHEN place <= 4 THEN 1 WHEN place <= 10 THEN 2 WHEN place <= 20 THEN 3 END AS INTEGER) AS batch FROM p"


def blind_queue(spark: SparkSession, sf: str) -> DataFrame:
    q, _ = C.blind_queue(V.chunks(spark, sf), "doc_id", "seed-1", ["lang"])
    return q


BLIND_QUEUE = "SELECT 'blind_' || left(sha256('seed-1|' || doc_id), 20) AS blind_id, lang FROM documents"


def gold_freeze(spark: SparkSession, sf: str) -> DataFrame:
    """Adjudicated toxicity over the first pass's quality."""
    labels = V.table(spark, sf, "labels")
    first = labels.select("doc_id", F.col("quality").alias("decision"))
    second = labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("decision"))
    return C.overlay(first, second, "doc_id", ["decision"])


GOLD_FREEZE = "SELECT doc_id, CASE WHEN toxic = 1 THEN toxic ELSE quality END AS decision, coalesce(toxic = 1, false) AS adjudicated FROM labels"


def preflight_plan(spark: SparkSession, sf: str) -> DataFrame:
    samples = V.questions(spark, sf).select(F.col("query_id").alias("sample_id"))
    methods = V.table(spark, sf, "region").select(F.col("r_name").alias("method_id"))
    models = V.table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("model_id"))
    return C.method_plan(samples, methods, models)


PREFLIGHT_PLAN = "SELECT item_id AS sample_id, r_name AS method_id, n_name AS model_id, sha256(item_id || '|' || r_name || '|' || n_name) AS cache_key FROM benchmark, region, (SELECT * FROM nation WHERE n_regionkey = 0)"


def call_status(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as planned calls, line items as cached records: a fully shipped order is a hit."""
    plan = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cache_key"))
    cache = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cache_key"), F.when(F.col("l_linestatus") == "F", "success").otherwise("error").alias("status"))
    return C.cached_or_planned(plan, cache, most_tries=3).groupBy("status").agg(F.count("*").alias("n"))


CALL_STATUS = "SELECT status, count(*) AS n FROM (SELECT o_orderkey, CASE WHEN coalesce(bool_or(l_linestatus = 'F'), false) THEN 'cache_hit' WHEN count(l_orderkey) >= 3 THEN 'given_up' WHEN count(l_orderkey) > 0 THEN 'failed' ELSE 'planned' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY status"


def quarantine_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left")
    checks = [("missing_label", F.col("quality").isNull()), ("low_quality", F.col("quality") == 0), ("toxic", F.coalesce(F.col("toxic") == 1, F.lit(False))), ("short", F.col("n_chars") < 200)]
    return K.quarantine(d, checks).groupBy("reason").agg(F.count("*").alias("n"))


QUARANTINE_REASONS = "SELECT CASE WHEN quality IS NULL THEN 'missing_label' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' ELSE 'pool' END AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"


def independence_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hang together by an equal text or an equal length: chains of both relations."""
    d = V.chunks(spark, sf).select("doc_id", F.sha2("content", 256).alias("text"), F.length("content").alias("size"))
    same = lambda c: d.join(d.groupBy(c).agg(F.min("doc_id").alias("a")), c).select("a", F.col("doc_id").alias("b"))
    return C.independence_components(same("text").unionByName(same("size")), d.select(F.col("doc_id").alias("id")))


INDEPENDENCE_COMPONENTS = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT min(doc_id) OVER (PARTITION BY t) AS a, doc_id AS b FROM d UNION ALL SELECT min(doc_id) OVER (PARTITION BY length(t)), doc_id FROM d) WHERE a <> b), two AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT two.b, reach.c FROM reach JOIN two ON two.a = reach.id WHERE reach.c < two.b)
SELECT id, min(c) AS component FROM reach GROUP BY id"""


def quota_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as components: exact counts per region class with the greatest balance, by dynamic programming."""
    n = V.table(spark, sf, "nation").join(V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers")), "n_nationkey", "left").na.fill(0)
    rows = n.orderBy("n_nationkey").collect()
    components = [(r.n_nationkey, tuple(int(r.n_regionkey == k) for k in range(5)), (r.customers, 1)) for r in rows]
    chosen = C.select_by_quota(components, (2, 2, 2, 1, 1)) or []
    return spark.createDataFrame([(int(c),) for c in chosen], "n_nationkey int")


QUOTA_SELECTION = "SELECT n_nationkey FROM (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(customers, 0) DESC, n_nationkey) AS r FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY 1) USING (n_nationkey)) WHERE r <= CASE WHEN n_regionkey <= 2 THEN 2 ELSE 1 END"


def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    """Market segments of a nation as components, order states as decisions: whole nations for a split of given counts.

    The target is what the nations with keys below 3 hold, so that a choice exists; nations come in the order of keys.
    """
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.groupBy("c_nationkey").agg(*[F.count_if(F.col("o_orderstatus") == x).alias(x) for x in "FOP"], F.count_if(F.col("o_custkey") % 2 == 0).alias("two"), F.count_distinct("o_custkey").alias("pages")).orderBy("c_nationkey").collect()
    target = tuple(sum(r[x] for r in rows if r.c_nationkey < 3) for x in "FOP")
    two = sum(r.two for r in rows if r.c_nationkey < 3)
    chosen = C.grouped_split([(r.c_nationkey, (r.F, r.O, r.P), r.two, r.pages) for r in rows], target, two) or []
    return spark.createDataFrame([(int(c),) for c in chosen], "c_nationkey int")


GROUPED_SPLIT = """WITH RECURSIVE n AS MATERIALIZED (SELECT CAST(c_nationkey AS INTEGER) AS k, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_custkey % 2 = 0) AS two, count(DISTINCT o_custkey) AS pages
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
), t AS (SELECT sum(f) AS f, sum(o) AS o, sum(p) AS p, sum(two) AS two FROM n WHERE k < 3
), s AS (SELECT []::INTEGER[] AS l, -1 AS last, 0::HUGEINT AS f, 0::HUGEINT AS o, 0::HUGEINT AS p, 0::HUGEINT AS two, 0::HUGEINT AS pages
  UNION ALL SELECT list_append(s.l, n.k), n.k, s.f + n.f, s.o + n.o, s.p + n.p, s.two + n.two, s.pages + n.pages FROM s JOIN n ON n.k > s.last, t WHERE s.f + n.f <= t.f AND s.o + n.o <= t.o AND s.p + n.p <= t.p)
SELECT unnest(l) AS c_nationkey FROM (SELECT s.l FROM s, t WHERE s.f = t.f AND s.o = t.o AND s.p = t.p ORDER BY abs(s.two - t.two), -s.pages, s.two, s.l LIMIT 1)"""


def diverse_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).withColumn("len", F.abs(F.length("content") - 600))
    rows = c.select("source_file", "len", "doc_id", "page_number", F.col("lang").alias("topic"), F.col("candidate_key").alias("id"))
    return C.diverse_shortlist(rows, "source_file", 5, ("len", "doc_id"))


DIVERSE_SHORTLIST = "WITH RECURSIVE " + V.CHUNKS + """, r AS MATERIALIZED (SELECT source_file AS g, candidate_key AS i, page_number AS p, lang AS t, row_number() OVER (PARTITION BY source_file ORDER BY abs(length(content) - 600), doc_id) AS n, count(*) OVER (PARTITION BY source_file) AS all_rows FROM chunks
), k AS (
  SELECT DISTINCT g, 0::BIGINT AS step, all_rows, []::STRUCT(i VARCHAR, p INTEGER, t VARCHAR)[] AS picks FROM r
  UNION ALL
  SELECT k.g, k.step + 1, k.all_rows, CASE WHEN len(picks) < 5 AND len(list_filter(picks, lambda x: x.i = r.i)) = 0 AND CASE k.step // k.all_rows
      WHEN 0 THEN r.t IS NOT NULL AND len(list_filter(picks, lambda x: x.p = r.p OR x.t = r.t)) = 0 WHEN 1 THEN len(list_filter(picks, lambda x: x.p = r.p)) = 0 ELSE true END
    THEN list_append(picks, {'i': r.i, 'p': r.p, 't': r.t}) ELSE picks END
  FROM k JOIN r ON r.g = k.g AND r.n = k.step % k.all_rows + 1 WHERE k.step < 3 * k.all_rows
), z AS (SELECT * FROM k WHERE step = 3 * all_rows)
SELECT g AS source_file, pick, picks[pick].i AS id, picks[pick].p AS page_number, picks[pick].t AS topic FROM (SELECT g, picks, CAST(unnest(range(1, len(picks) + 1)) AS INTEGER) AS pick FROM z)"""


def compare_and_swap(spark: SparkSession, sf: str) -> DataFrame:
    labels = V.table(spark, sf, "labels").select("doc_id", "quality")
    edits = V.table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("expected_old"), F.lit(0).alias("new_value"))
    return K.compare_and_swap(labels, ["doc_id"], "quality", edits)[0]


COMPARE_AND_SWAP = "SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 0 ELSE quality END AS quality FROM labels"


def policy_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as rules; each must occur verbatim in the document that cites it."""
    g = V.gold(spark, sf)
    rows = g.join(V.chunks(spark, sf).select("candidate_key", "content"), "candidate_key").select(F.col("query_id").alias("id"), F.array(F.col("query_id").cast("string")).alias("policy_ids"), "content")
    policies = V.questions(spark, sf).select(F.col("query_id").cast("string").alias("policy_id"), F.col("query").alias("policy_text"))
    return C.bind_policies(rows, policies, F.col("content")).select("id", F.length("evidence").alias("evidence_chars"), "bound")


POLICY_BINDING = "WITH " + V.GOLD + " SELECT query_id AS id, CAST(length(anchor_text_span) AS INTEGER) AS evidence_chars, true AS bound FROM gold"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return V.chunks(spark, sf).select(F.col("doc_id").alias("block_id"), F.when(F.contains("content", F.lit(" | ")), "table").otherwise("text").alias("block_type"), "content", "source_file", "page_number")


def chunk_three_granularity(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk_blocks(_blocks(spark, sf))
    return c.select("block_id", "granularity", "chunk_in_block", F.length("content").alias("chars"), "token_count", F.sha2("content", 256).alias("digest"))


def rebuild_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    c = chunking.chunk_blocks(b).join(b.select("block_id", "source_file"), "block_id")
    return A.rebuild_summary(b, c)


def collection_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).withColumn("collection", F.col("lang"))
    return A.collection_audit(c, is_noise("content")).select("collection", "source_file", "chunks", "pages", "first_page", "last_page")


COLLECTION_AUDIT = "WITH " + V.CHUNKS + " SELECT lang AS collection, source_file, count(*) AS chunks, count(DISTINCT page_number) AS pages, min(page_number) AS first_page, max(page_number) AS last_page FROM chunks GROUP BY ALL"


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf)
    audit = c.select(F.col("lang").alias("collection"), "source_file").distinct()
    expected = c.select("source_file").distinct().unionByName(spark.createDataFrame([("never",)], "source_file string"))
    return A.completeness(audit, expected, ("en", "fr", "de", "es"))


COMPLETENESS = "WITH " + V.CHUNKS + """, w AS (SELECT c, s FROM (SELECT unnest(['en', 'fr', 'de', 'es']) AS c), (SELECT DISTINCT source_file AS s FROM chunks UNION ALL SELECT 'never')), h AS (SELECT DISTINCT lang AS c, source_file AS s FROM chunks),
b AS (SELECT coalesce(w.c, h.c) AS collection, w.s IS NOT NULL AS want, h.s IS NOT NULL AS have FROM w FULL JOIN h ON w.c = h.c AND w.s = h.s)
SELECT collection, count(*) FILTER (want AND NOT have) AS missing, count(*) FILTER (NOT want) AS unexpected, count(*) FILTER (want AND NOT have) = 0 AND count(*) FILTER (NOT want) = 0 AS complete FROM b GROUP BY collection"""


def sparse_index_audit(spark: SparkSession, sf: str) -> DataFrame:
    d, _ = V.word_weights(spark, sf)
    return A.sparse_audit(d, V.chunks(spark, sf))


SPARSE_INDEX_AUDIT = "WITH " + V.ROUTED + " SELECT (SELECT count(*) FROM dw) AS nnz, (SELECT count(DISTINCT token) FROM dw) AS tokens, (SELECT count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM dw WHERE dw.candidate_key = c.candidate_key)) AS empty_vectors, (SELECT CAST(count(*) - count(DISTINCT candidate_key) AS BIGINT) FROM chunks) AS duplicates, (SELECT count(*) FROM chunks WHERE coalesce(trim(source_file), '') = '') AS missing_source"


def graph_index_audit(spark: SparkSession, sf: str) -> DataFrame:
    return A.graph_index_audit(V.chunks(spark, sf), V.constraints(spark, sf))


GRAPH_INDEX_AUDIT = "WITH " + V.CONSTRAINTS + " SELECT (SELECT count(*) FROM chunks) AS candidates, (SELECT count(DISTINCT candidate_key) FROM chunks) AS unique_candidates, (SELECT count(*) FROM (SELECT DISTINCT source_file, page_number FROM chunks)) AS source_pages, (SELECT count(*) FROM xc) AS pairs, (SELECT count(*) FROM (SELECT DISTINCT ctype, cvalue FROM xc)) AS posting_keys, (SELECT count(DISTINCT ctype) FROM xc) AS types"


def collection_dims(spark: SparkSession, sf: str) -> DataFrame:
    return A.collection_dims(V.vectors(spark, sf))


COLLECTION_DIMS = "WITH " + V.VECTORS + " SELECT collection, count(*) AS vectors, CAST(max(len(e)) AS INTEGER) AS dim FROM vectors GROUP BY collection"


def source_inspection(spark: SparkSession, sf: str) -> DataFrame:
    p = V.chunks(spark, sf).select("source_file", "page_number", (F.length("content") >= 3000).alias("has_text"), F.contains("content", F.lit("|")).alias("has_image"))
    return S.inspect_sources(p)


SOURCE_INSPECTION = "WITH " + V.CHUNKS + ", s AS (SELECT source_file, count(*) AS sampled_pages, count(*) FILTER (length(content) >= 3000) AS text_pages, count(*) FILTER (contains(content, '|')) AS image_pages FROM chunks WHERE page_number <= 30 GROUP BY ALL) SELECT *, text_pages / sampled_pages < 0.2 AND image_pages / sampled_pages >= 0.8 AS scan_heavy FROM s"


def html_text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "pages").select("page_id", "url", S.html_text("html").alias("content"))
    return S.text_blocks(p).select("page_id", F.length("content").alias("chars"), X.tokens_by_pages("content").alias("token_estimate"))


_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\n{{3,}}', '\n\n', 'g'))"
HTML_TEXT_BLOCKS = "WITH p AS (SELECT page_id, " + _CLEAN.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)</(p|div|li|h[1-6]|tr)>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g')").replace("'\\n\\n'", "chr(10) || chr(10)") + " AS t FROM pages) SELECT page_id, CAST(length(t) AS INTEGER) AS chars, CAST(floor(length(t) * 1.5::DOUBLE) AS INTEGER) AS token_estimate FROM p WHERE length(t) >= 20 AND NOT regexp_matches(t, '" + REFERENCE_HEADING + "')"


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries of line items; the later one wins for each part."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.xxhash64("l_orderkey", "l_linenumber").alias("h"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag")
    out = S.upsert(li.where("l_returnflag <> 'N'"), li.where("l_returnflag = 'N'"), "id", "seq")
    return out.select("id", "l_orderkey", "l_linenumber", "l_returnflag")


STORE_UPSERT = "SELECT l_partkey AS id, l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'N')::INT DESC, l_orderkey * 10 + l_linenumber DESC) = 1"


def unseen_files(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("source_hash"), F.floor("c_acctbal").cast("long").alias("granularity"), "c_custkey")
    s = V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source_hash"), F.floor("s_acctbal").cast("long").alias("granularity"))
    return S.unseen_files(c, s)


UNSEEN_FILES = "SELECT c_nationkey AS source_hash, CAST(floor(c_acctbal) AS BIGINT) AS granularity, c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey = c_nationkey AND floor(s_acctbal) = floor(c_acctbal))"


def asset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return S.asset_manifest(V.vectors(spark, sf), "embedding", ["collection"]).select("collection", "vectors", "dim", "ready")


ASSET_MANIFEST = "WITH " + V.VECTORS + " SELECT collection, count(*) AS vectors, CAST(max(len(e)) AS INTEGER) AS dim, min(len(e)) = max(len(e)) AS ready FROM vectors GROUP BY collection"


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return K.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey"])


DUPLICATE_KEYS = "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL"


def unequal_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Customers against those who order, with a few keys that only one side has."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).unionByName(spark.createDataFrame([(-1,), (-2,)], "k long"))
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionByName(spark.createDataFrame([(-2,), (-3,)], "k long"))
    return K.unequal_keys(c, o, ["k"])


UNEQUAL_KEYS = "WITH c AS (SELECT c_custkey AS k FROM customer UNION ALL VALUES (-1), (-2)), o AS (SELECT DISTINCT o_custkey AS k FROM orders UNION ALL VALUES (-2), (-3)) SELECT k, 'missing' AS violation FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'unexpected' FROM o WHERE k NOT IN (SELECT k FROM c)"


def distribution_drift(spark: SparkSession, sf: str) -> DataFrame:
    expected = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.lit(300).cast("long").alias("expected"))
    c = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("k"))
    return K.drift(c, expected, ["k"])


DISTRIBUTION_DRIFT = "SELECT r_regionkey AS k, coalesce(n, 0) AS actual, CAST(300 AS BIGINT) AS expected, coalesce(n, 0) - 300 AS surplus FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r_regionkey WHERE coalesce(n, 0) <> 300"


def changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields of an order's first line differ from its second line."""
    li = V.table(spark, sf, "lineitem")
    names = ["l_returnflag", "l_linestatus", "l_tax"]
    return K.changed_fields(li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), ["l_orderkey"], names)


CHANGED_FIELDS = """SELECT b.l_orderkey, array_to_string(list_filter([CASE WHEN a.l_returnflag IS DISTINCT FROM b.l_returnflag THEN 'l_returnflag' END, CASE WHEN a.l_linestatus IS DISTINCT FROM b.l_linestatus THEN 'l_linestatus' END, CASE WHEN a.l_tax IS DISTINCT FROM b.l_tax THEN 'l_tax' END], lambda x: x IS NOT NULL), ',') AS changed
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.l_returnflag IS DISTINCT FROM b.l_returnflag OR a.l_linestatus IS DISTINCT FROM b.l_linestatus OR a.l_tax IS DISTINCT FROM b.l_tax"""


def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return K.fingerprint(V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


TABLE_FINGERPRINT = "SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(o_custkey || chr(31) || o_orderkey || chr(31) || o_orderstatus), 1, 15)) AS HUGEINT)) AS VARCHAR) AS digest FROM orders"


def text_dialects(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf)
    return c.select("doc_id", F.sha2(X.norm_text("content"), 256).alias("norm_text"), F.sha2(X.norm_ws("content"), 256).alias("norm_ws"), X.norm_source("source_file").alias("norm_source"), X.slug("source_file").alias("slug"), X.tokens_by_chars("content").alias("tokens_chunk"), X.tokens_by_pages("content").alias("tokens_page"), X.tokens_by_prompt("content").alias("tokens_prompt"), X.compact_text("content", 60).alias("compact"))


TEXT_DIALECTS = "WITH " + V.CHUNKS + f""", w AS (SELECT *, trim(regexp_replace(content, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS ws FROM chunks)
SELECT doc_id, sha256({_NORM.format('content')}) AS norm_text, sha256(ws) AS norm_ws, lower(source_file) AS norm_source, lower(source_file) AS slug, CAST(greatest(1, floor(length(content) / 1.5::DOUBLE)) AS INTEGER) AS tokens_chunk, CAST(floor(length(content) * 1.5::DOUBLE) AS INTEGER) AS tokens_page,
  CAST(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, ceil(length(content) / 1.8::DOUBLE)) END AS INTEGER) AS tokens_prompt, CASE WHEN length(ws) <= 60 THEN ws ELSE rtrim(left(ws, 57)) || '...' END AS compact FROM w"""


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = V.chunks(spark, sf).select("doc_id", X.split_sentences("content").alias("s"))
    return c.select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", "\u0001"), 256).alias("digest"))


_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKS = r"。；;.!！?？\n"
SENTENCE_COUNTS = "WITH " + V.CHUNKS + f""", p AS (SELECT doc_id, regexp_extract_all(content, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+$') AS l FROM chunks
), s AS (SELECT doc_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '[{_MARKS}]$', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') || replace(regexp_extract(x, '[{_MARKS}]$'), chr(10), ''))), lambda x: x <> '') AS s FROM p)
SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, sha256(array_to_string(s, chr(1))) AS digest FROM s"""

_STRIP = _SPACE.replace("[", "[\\x1c-\\x1f", 1)
_CHUNKED = "WITH RECURSIVE " + V.CHUNKS + f""", b AS (SELECT doc_id, source_file, page_number, content, contains(content, ' | ') AS is_table FROM chunks
), se AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(content, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+$'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[{_MARKS}]$', ''), '^{_STRIP}+|{_STRIP}+$', '', 'g') || regexp_extract(x, '[{_MARKS}]$'), '^{_STRIP}+|{_STRIP}+$', '', 'g')), lambda x: x <> '') AS s FROM b WHERE NOT is_table
), sz AS (SELECT doc_id, s, list_transform(s, lambda x: CAST(greatest(1, floor(length(x) / 1.5::DOUBLE)) AS INTEGER)) AS z FROM se
), p AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, list_transform(range(0, len(s) + 1), lambda i: coalesce(CAST(list_sum(z[1:i]) AS INTEGER), 0)) AS c FROM sz
), gr(g, t, o) AS (VALUES (128, 128, 32), (512, 512, 64), (1024, 1024, 128)
), w AS (
  SELECT doc_id, g, t, o, 0 AS i, 0::BIGINT AS st, greatest(1, list_max(list_filter(range(0, n + 1), lambda e: c[e + 1] <= t))) AS en FROM p, gr WHERE n > 0
  UNION ALL
  SELECT doc_id, g, t, o, i + 1, ns, greatest(ns + 1, list_max(list_filter(range(ns, n + 1), lambda e: c[e + 1] - c[ns + 1] <= t))) FROM (
    SELECT w.doc_id, g, t, o, i, c, n, greatest(st + 1, list_min(list_filter(range(st, en + 1), lambda k: c[en + 1] - c[k + 1] <= o))) AS ns FROM w JOIN p ON p.doc_id = w.doc_id) WHERE ns < n
), ck AS MATERIALIZED (
  SELECT w.doc_id, g, i, array_to_string(s[st + 1:en], '') AS content, c[en + 1] - c[st + 1] AS tokens FROM w JOIN p ON p.doc_id = w.doc_id
  UNION ALL SELECT doc_id, g, 0, content, CAST(greatest(1, floor(length(content) / 1.5::DOUBLE)) AS INTEGER) FROM b, gr WHERE is_table)"""
CHUNK_THREE_GRANULARITY = _CHUNKED + " SELECT doc_id AS block_id, CAST(g AS INTEGER) AS granularity, CAST(i AS INTEGER) AS chunk_in_block, CAST(length(content) AS INTEGER) AS chars, CAST(tokens AS INTEGER) AS token_count, sha256(content) AS digest FROM ck"
REBUILD_SUMMARY = _CHUNKED + """, bs AS (SELECT source_file, count(*) FILTER (NOT is_table) AS text_blocks, count(*) FILTER (is_table) AS table_blocks, min(page_number) AS first_page, max(page_number) AS last_page FROM b GROUP BY 1
), cs AS (SELECT source_file, count(*) FILTER (g = 128) AS chunks_128, count(*) FILTER (g = 512) AS chunks_512, count(*) FILTER (g = 1024) AS chunks_1024 FROM ck JOIN b ON b.doc_id = ck.doc_id GROUP BY 1)
SELECT source_file, text_blocks, table_blocks, first_page, last_page, coalesce(chunks_128, 0) AS chunks_128, coalesce(chunks_512, 0) AS chunks_512, coalesce(chunks_1024, 0) AS chunks_1024, CASE WHEN text_blocks + table_blocks = 0 THEN 'no_blocks' WHEN coalesce(chunks_128, 0) = 0 OR coalesce(chunks_512, 0) = 0 OR coalesce(chunks_1024, 0) = 0 THEN 'incomplete' ELSE 'ready' END AS status FROM bs LEFT JOIN cs USING (source_file)"""

QUERIES = {
    "near_dup_pairs": (near_dup_pairs, NEAR_DUP_PAIRS),
    "near_dup_best": (near_dup_best, NEAR_DUP_BEST),
    "canonical_dups": (canonical_dups, CANONICAL_DUPS),
    "leakage_join": (leakage_join, LEAKAGE_JOIN),
    "two_pass_agreement": (two_pass_agreement, TWO_PASS_AGREEMENT),
    "transition_counts": (transition_counts, TRANSITION_COUNTS),
    "resolution_queue": (resolution_queue, RESOLUTION_QUEUE),
    "sized_batches": (sized_batches, SIZED_BATCHES),
    "blind_queue": (blind_queue, BLIND_QUEUE),
    "gold_freeze": (gold_freeze, GOLD_FREEZE),
    "preflight_plan": (preflight_plan, PREFLIGHT_PLAN),
    "call_status": (call_status, CALL_STATUS),
    "quarantine_reasons": (quarantine_reasons, QUARANTINE_REASONS),
    "independence_components": (independence_components, INDEPENDENCE_COMPONENTS),
    "quota_selection": (quota_selection, QUOTA_SELECTION),
    "grouped_split": (grouped_split, GROUPED_SPLIT),
    "diverse_shortlist": (diverse_shortlist, DIVERSE_SHORTLIST),
    "compare_and_swap": (compare_and_swap, COMPARE_AND_SWAP),
    "policy_binding": (policy_binding, POLICY_BINDING),
    "chunk_three_granularity": (chunk_three_granularity, CHUNK_THREE_GRANULARITY),
    "rebuild_summary": (rebuild_summary, REBUILD_SUMMARY),
    "collection_audit": (collection_audit, COLLECTION_AUDIT),
    "completeness": (completeness, COMPLETENESS),
    "sparse_index_audit": (sparse_index_audit, SPARSE_INDEX_AUDIT),
    "graph_index_audit": (graph_index_audit, GRAPH_INDEX_AUDIT),
    "collection_dims": (collection_dims, COLLECTION_DIMS),
    "source_inspection": (source_inspection, SOURCE_INSPECTION),
    "html_text_blocks": (html_text_blocks, HTML_TEXT_BLOCKS),
    "store_upsert": (store_upsert, STORE_UPSERT),
    "unseen_files": (unseen_files, UNSEEN_FILES),
    "asset_manifest": (asset_manifest, ASSET_MANIFEST),
    "duplicate_keys": (duplicate_keys, DUPLICATE_KEYS),
    "unequal_keys": (unequal_keys, UNEQUAL_KEYS),
    "distribution_drift": (distribution_drift, DISTRIBUTION_DRIFT),
    "changed_fields": (changed_fields, CHANGED_FIELDS),
    "table_fingerprint": (table_fingerprint, TABLE_FINGERPRINT),
    "text_dialects": (text_dialects, TEXT_DIALECTS),
    "sentence_counts": (sentence_counts, SENTENCE_COUNTS),
}
