"""The engine's entities as views of the TPC-like and document tables, in Spark and in DuckDB's SQL.

Documents stand for chunks of evidence: a source file and, in order of id, its pages. Benchmark passages stand for
questions; the first document that holds a passage is its gold page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions.text import tokens
from evidrill.operators.evaluation import holders
from evidrill.operators.retrieval import ranked

#: Sources of the document tables; document n of a source is its page n.
SOURCES = 20

#: Alias table over frequent words: (type, value, aliases, strong anchor).
LEXICON = (
    ("clinical_condition", "north", ("that", "la"), True),
    ("clinical_condition", "south", ("from", "de"), True),
    ("medication", "reed", ("as", "que"), True),
    ("medication_class", "antimicrobial", ("the",), False),
    ("medication_class", "macrolide", ("for", "der"), False),
    ("frequency", "qd", ("is",), False),
    ("frequency", "bid", ("it",), False),
    ("route", "iv_unspecified", ("with",), False),
    ("route", "iv_infusion", ("be",), False),
    ("dose", "10mg/kg", ("re",), False),
    ("dose", "10mg/kg/day", ("en",), False),
    ("age_group", "infant", ("was",), False),
    ("evidence_scope", "dose_guidance", ("er",), False),
)
AUTHORITY = (("src1", "clinical_guideline"), ("src2", "expert_consensus"), ("src0", "national_pharmacopoeia"))
EXPANSIONS = ((("with", "avec"), "alpha beta"), (("under", "nicht"), "gamma"), (("this",), "alpha beta"))


#: Tables of at least the first size and less than the second for each core are dealt out: their files may have fewer
#: row groups than there are cores. Larger ones have splits enough.
DEALT_BYTES = 256 << 10, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its rows on all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if DEALT_BYTES[0] <= size < DEALT_BYTES[1] * cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    page = (F.floor(F.col("doc_id") / SOURCES) + 1).cast("int")
    return d.select("doc_id", F.concat(F.lit("doc::"), F.col("doc_id")).alias("candidate_key"), F.col("source").alias("source_file"), page.alias("page_number"), F.coalesce("text", F.lit("")).alias("content"), "lang")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    collection = F.element_at(F.array(F.lit("128"), F.lit("512"), F.lit("1024")), (F.col("label") % 3 + 1).cast("int"))
    return e.select("vec_id", F.format_string("v%06d", "vec_id").alias("candidate_key"), collection.alias("collection"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by twenty, against all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document that holds each passage."""
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    first = holders(c, q).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    places = first.join(c.select("doc_id", "source_file", "page_number", "candidate_key"), "doc_id")
    return places.join(q.withColumnRenamed("query", "anchor_text_span"), "query_id").select("query_id", "source_file", "page_number", "candidate_key", "anchor_text_span")


def word_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, questions) as (key, token, weight) by term frequency.

    Texts are dealt by key before they fall into words, so that neither the counts nor dot products with a broadcast
    side shuffle the words, which are many times larger.
    """
    count = lambda df, key, text: df.select(key, text).repartition(key).select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("weight"))
    return count(chunks(spark, sf_dir), "candidate_key", "content"), count(questions(spark, sf_dir), "query_id", "query")


def routed(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Two routes for every question: word frequencies and shared distinct words; one join serves both."""
    d, q = word_weights(spark, sf_dir)
    dots = d.join(q.withColumnRenamed("weight", "qw"), "token").groupBy("query_id", "candidate_key").agg(F.sum(F.col("weight") * F.col("qw")).alias("sparse"), F.count("*").cast("double").alias("dense"))
    both = dots.select("query_id", "candidate_key", F.explode(F.create_map(F.lit("sparse"), F.col("sparse"), F.lit("dense"), F.col("dense"))).alias("method_id", "raw_score"))
    top = ranked(both, ["query_id", "method_id"], [F.col("raw_score").desc(), F.col("candidate_key")], k, "route_rank")
    pages = chunks(spark, sf_dir).select("candidate_key", "source_file", "page_number")
    return top.join(pages, "candidate_key").withColumn("route", F.col("method_id")).withColumn("rank", F.col("route_rank"))


def evidence(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """The first k candidates of each route with their texts."""
    top = routed(spark, sf_dir).where(F.col("rank") <= k)
    return top.join(chunks(spark, sf_dir).select("candidate_key", "content"), "candidate_key")


# The same views in SQL, as common table expressions.
_PAGE = f"CAST(doc_id // {SOURCES} + 1 AS INTEGER)"
CHUNKS = f"chunks AS (SELECT doc_id, 'doc::' || doc_id AS candidate_key, source AS source_file, {_PAGE} AS page_number, coalesce(text, '') AS content, lang FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"
VECTORS = "vectors AS (SELECT vec_id, 'v' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS candidate_key, CASE label % 3 WHEN 0 THEN '128' WHEN 1 THEN '512' ELSE '1024' END AS collection, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
DENSE = VECTORS + """, dist AS (
  SELECT q.vec_id AS query_id, v.collection, v.candidate_key, pow(list_distance(q.e, v.e), 2) AS distance
  FROM vectors v CROSS JOIN (SELECT vec_id, e FROM vectors WHERE vec_id % 20 = 0) q
), dense AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, candidate_key) AS INTEGER) AS route_rank FROM dist
  QUALIFY route_rank <= 5
)"""
GOLD = CHUNKS + ", " + QUESTIONS + """, gold AS (
  SELECT query_id, source_file, page_number, candidate_key, query AS anchor_text_span FROM chunks JOIN questions ON contains(content, query) AND query <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) = 1
)"""
ROUTED = GOLD + """, dw AS (
  SELECT candidate_key, token, CAST(count(*) AS DOUBLE) AS w FROM (SELECT candidate_key, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS token FROM chunks) GROUP BY ALL
), qw AS (
  SELECT query_id, token, CAST(count(*) AS DOUBLE) AS w FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM questions) GROUP BY ALL
), dots AS MATERIALIZED (
  SELECT query_id, candidate_key, sum(dw.w * qw.w) AS sparse, CAST(count(*) AS DOUBLE) AS dense FROM dw JOIN qw USING (token) GROUP BY ALL
), routes AS (
  SELECT query_id, candidate_key, 'sparse' AS method_id, sparse AS raw_score FROM dots UNION ALL SELECT query_id, candidate_key, 'dense', dense FROM dots
), routed AS MATERIALIZED (
  SELECT r.*, c.source_file, c.page_number, method_id AS route, route_rank AS rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id, method_id ORDER BY raw_score DESC, candidate_key) AS INTEGER) AS route_rank FROM routes QUALIFY route_rank <= 20
  ) r JOIN chunks c USING (candidate_key)
)"""


def lexicon_values() -> str:
    """The lexicon as rows of SQL, one for each alias."""
    rows = [f"('{t}', '{v}', '{a}', {str(s or t in ('audit_domain', 'clinical_condition', 'medication', 'medication_class')).lower()})" for t, v, aliases, s in LEXICON for a in aliases]
    return f"lex(ctype, cvalue, alias, strong) AS (VALUES {', '.join(rows)})"


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
CONSTRAINTS = ROUTED + ", " + lexicon_values() + f""", cw AS (
  SELECT candidate_key AS owner_id, unnest({_WORDS.format('content')}) AS word FROM chunks
), cc AS MATERIALIZED (
  SELECT owner_id, 'content' AS scope, ctype, cvalue, bool_or(strong) AS strong FROM cw JOIN lex ON word = alias GROUP BY ALL
), sc AS (
  SELECT candidate_key AS owner_id, 'source' AS scope, 'clinical_condition' AS ctype, CASE WHEN source_file IN ('src1', 'src2', 'src3') THEN 'north' ELSE 'south' END AS cvalue, true AS strong
  FROM chunks WHERE source_file IN ('src1', 'src2', 'src3', 'src4', 'src5')
), xc AS (
  SELECT owner_id, 'context' AS scope, ctype, cvalue, bool_or(strong) AS strong FROM (SELECT * FROM cc UNION ALL SELECT * FROM sc) GROUP BY owner_id, ctype, cvalue
), cons AS MATERIALIZED (SELECT * FROM cc UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM xc
), qc AS MATERIALIZED (
  SELECT query_id, ctype, cvalue, bool_or(strong) AS strong FROM (SELECT query_id, unnest({_WORDS.format('query')}) AS word FROM questions) JOIN lex ON word = alias GROUP BY ALL
)"""


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of chunks: lexicon matches in the content, a condition from some sources, and their union as context."""
    from evidrill.functions.constraints import lexicon_constraints, merge_constraints, with_context

    c = chunks(spark, sf_dir)
    content = lexicon_constraints(c.select(F.col("candidate_key").alias("owner_id"), F.lit("content").alias("scope"), F.col("content").alias("text")), LEXICON)
    named = c.where(F.col("source_file").isin("src1", "src2", "src3", "src4", "src5"))
    value = F.when(F.col("source_file").isin("src1", "src2", "src3"), "north").otherwise("south")
    source = named.select(F.col("candidate_key").alias("owner_id"), F.lit("source").alias("scope"), F.lit("clinical_condition").alias("ctype"), value.alias("cvalue"), F.array("source_file").alias("surface_forms"), F.lit(True).alias("strong"))
    return with_context(merge_constraints(content, source))


def query_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidrill.functions.constraints import lexicon_constraints, merge_constraints

    q = questions(spark, sf_dir)
    found = merge_constraints(lexicon_constraints(q.select(F.col("query_id").alias("owner_id"), F.lit("query").alias("scope"), F.col("query").alias("text")), LEXICON))
    return found.select(F.col("owner_id").cast("long").alias("query_id"), "ctype", "cvalue", "strong")
