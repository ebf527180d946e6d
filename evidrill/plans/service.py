"""The online service's retrieval and audit as one batched plan over all queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.rules import authority_weight, boost, expand_query, is_noise
from evidrill.operators.retrieval import dense_top_k, first_by_signature, lexical_fallback, required_term_filter, trust_score


def score_evidence(rows: DataFrame, authority: Column | None = None) -> DataFrame:
    """relevance x authority x boost, in that order of multiplication."""
    weighted = rows.withColumn("authority_weight", authority if authority is not None else authority_weight("source_file"))
    return weighted.withColumn("final_score", F.col("relevance_score") * F.col("authority_weight") * boost("query", "source_file", "content"))


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 5, authority: Column | None = None, include_tables: bool = True) -> DataFrame:
    """Evidence of each query in service order: dense hits per granularity and lexical fallbacks, scored, filtered, deduped.

    ``chunks(candidate_key, granularity, source_file, page_number, block_type, content, embedding)``,
    ``queries(query_id, query, query_vector)``. Texts are joined to the ranked keys, after the top-k.
    """
    pool = chunks if include_tables else chunks.where("block_type <> 'table'")
    dense = dense_top_k(pool.withColumn("collection", F.col("granularity").cast("string")), queries, k)
    texts = pool.drop("embedding")
    hits = dense.select("query_id", "candidate_key", "distance", "route_rank").join(texts, "candidate_key").where(~is_noise("content")).withColumn("relevance_score", 1 / (1 + F.col("distance"))).withColumn("arrival", F.col("granularity") * 1000 + F.col("route_rank"))
    extra = lexical_fallback(texts.where(~is_noise("content")), queries, k).withColumn("arrival", F.lit(10_000_000) + F.col("rule") * 1000 + F.col("fallback_rank"))
    names = [*texts.columns, "query_id", "distance", "relevance_score", "arrival"]
    rows = hits.select(*names).unionByName(extra.select(*names)).join(queries.select("query_id", "query"), "query_id")
    scored = required_term_filter(score_evidence(rows, authority))
    order = [F.col("filter_class"), F.col("final_score").desc(), F.col("arrival")]
    kept = first_by_signature(scored, order)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def audit(evidence: DataFrame, drafts: DataFrame, faith: Column, conflict: Column | None = None) -> DataFrame:
    """Trust of each draft: nothing without a draft or evidence, little with a frequency conflict, else the judge's score."""
    top = evidence.where("rank = 1").select("query_id", "relevance_score", "authority_weight")
    df = drafts.join(top, "query_id", "left")
    nothing = F.col("relevance_score").isNull() | (F.trim(F.coalesce("draft", F.lit(""))) == "")
    s_faith = F.when(nothing, 0.0).when(conflict if conflict is not None else F.lit(False), 2.0).otherwise(faith)
    s_ret = F.when(nothing, 0.0).otherwise(F.col("relevance_score") * 10)
    weight = F.when(nothing, 0.0).otherwise(F.col("authority_weight"))
    score, level = trust_score(s_ret, s_faith, weight)
    return df.select("query_id", s_ret.alias("s_ret"), s_faith.alias("s_faith"), weight.alias("w_authority"), score.alias("trust_score"), level.alias("trust_level"))


def frequency_conflict(query: str | Column, evidence: Column) -> Column:
    """Twice a day is asked where the evidence says once."""
    from evidrill.functions.text import blank

    twice = r"(?i)(?:\bbid\b|每日\s*(?:两|二|2)\s*次|一天\s*(?:两|二|2)\s*次)"
    once = r"(?i)(?:\bqd\b|每日\s*(?:一|1)\s*次|一天\s*(?:一|1)\s*次)"
    return blank(query).rlike(twice) & evidence.rlike(once)


def retrieval_text(queries: DataFrame, rules: Sequence | None = None) -> DataFrame:
    """Queries with the text that is embedded: the query and its expansions."""
    return queries.withColumn("retrieval_text", expand_query("query", rules) if rules else expand_query("query"))
