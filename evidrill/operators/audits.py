"""Index audits: what each collection holds, and whether all sources are complete in all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collection_audit(chunks: DataFrame, noise: Column) -> DataFrame:
    """A5: Per collection and source: chunks, distinct pages, page range without page 0, noise chunks."""
    page = F.when(F.col("page_number") > 0, F.col("page_number"))
    return chunks.groupBy("collection", "source_file").agg(F.count("*").alias("chunks"), F.count_distinct(page).alias("pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count_if(noise).alias("noise_chunks"))


def completeness(audit: DataFrame, expected: DataFrame, collections: Sequence[str]) -> DataFrame:
    """Per collection: sources that it lacks or holds beyond the manifest, and whether it is complete."""
    want = expected.select("source_file").distinct().withColumn("collection", F.explode(F.array(*[F.lit(c) for c in collections])))
    have = audit.select("collection", "source_file", F.lit(True).alias("have"))
    both = want.withColumn("want", F.lit(True)).join(have, ["collection", "source_file"], "full_outer").na.fill(False, ["want", "have"])
    g = both.groupBy("collection").agg(F.count_if(F.col("want") & ~F.col("have")).alias("missing"), F.count_if(~F.col("want")).alias("unexpected"))
    return g.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def rebuild_summary(blocks: DataFrame, chunks: DataFrame, granularities: Sequence[int] = (128, 512, 1024)) -> DataFrame:
    """Per document: blocks by type, page range, chunks at each granularity, and a status from them."""
    b = blocks.groupBy("source_file").agg(F.count_if(F.col("block_type") == "text").alias("text_blocks"), F.count_if(F.col("block_type") == "table").alias("table_blocks"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    c = chunks.groupBy("source_file").agg(*[F.count_if(F.col("granularity") == g).alias(f"chunks_{g}") for g in granularities])
    df = b.join(c, "source_file", "left").na.fill(0)
    empty = F.lit(False)
    for g in granularities:
        empty = empty | (F.col(f"chunks_{g}") == 0)
    return df.withColumn("status", F.when(F.col("text_blocks") + F.col("table_blocks") == 0, "no_blocks").when(empty, "incomplete").otherwise("ready"))


def sparse_audit(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """Weights, empty vectors, repeated document ids and documents of unknown source of a sparse index."""
    n = postings.agg(F.count("*").alias("nnz"), F.count_distinct("token").alias("tokens"))
    held = documents.join(postings.select("candidate_key").distinct(), "candidate_key", "left_anti").agg(F.count("*").alias("empty_vectors"))
    ids = documents.groupBy("candidate_key").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))
    src = documents.agg(F.count_if(F.coalesce(F.trim("source_file"), F.lit("")) == "").alias("missing_source"))
    return n.crossJoin(held).crossJoin(ids).crossJoin(src)


def graph_index_audit(candidates: DataFrame, constraints: DataFrame) -> DataFrame:
    """Candidates, source pages, constraint pairs and index keys of a candidate graph."""
    c = candidates.agg(F.count("*").alias("candidates"), F.count_distinct("candidate_key").alias("unique_candidates"), F.count_distinct("source_file", "page_number").alias("source_pages"))
    p = constraints.where("scope = 'context'").agg(F.count_distinct("owner_id", "ctype", "cvalue").alias("pairs"), F.count_distinct("ctype", "cvalue").alias("posting_keys"), F.count_distinct("ctype").alias("types"))
    return c.crossJoin(p)


def collection_dims(vectors: DataFrame) -> DataFrame:
    """Vectors and dimension of each collection; the dimension of an empty one is 0."""
    return vectors.groupBy("collection").agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"))


def quota_violations(paths: DataFrame, max_per_source: int, max_per_page: int) -> DataFrame:
    """(query_id, source_violations, source_page_violations): sources and pages with more selected paths than allowed."""
    keyed = paths.select("query_id", F.coalesce("source_file", F.lit("")).alias("s"), F.coalesce("page_number", F.lit(0)).alias("p"))
    pages = keyed.groupBy("query_id", "s", "p").agg(F.count("*").alias("n"))
    sources = pages.groupBy("query_id", "s").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > max_per_page).alias("over"))
    return sources.groupBy("query_id").agg(F.count_if(F.col("n") > max_per_source).alias("source_violations"), F.sum("over").alias("source_page_violations"))


def routing_audit(questions: DataFrame, routed: DataFrame, max_per_source: int, max_per_page: int) -> DataFrame:
    """Per question, paths before and after routing, their sources and tiers, why paths were dropped, broken quotas.

    ``routed`` are the rows of ``route_with_quotas``.
    """
    chosen = F.col("route_decision") == "selected"
    listed = lambda rows, name: rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(x["k"], F.lit(":"), x["n"].cast("string"))), ",").alias(name))
    tiers = listed(routed.where(chosen).groupBy("query_id", F.col("tier").cast("string").alias("k")).agg(F.count("*").alias("n")), "tiers")
    drops = listed(routed.where(~chosen).groupBy("query_id", F.col("route_decision").alias("k")).agg(F.count("*").alias("n")), "drops")
    counts = routed.groupBy("query_id").agg(F.count("*").alias("raw_path_count"), F.count_if(chosen).alias("routed_path_count"), F.count_distinct(F.when(chosen, F.col("source_file"))).alias("candidate_source_count"))
    df = questions.select("query_id")
    for part in (counts, tiers, drops, quota_violations(routed.where(chosen), max_per_source, max_per_page)):
        df = df.join(part, "query_id", "left")
    return df.na.fill(0).na.fill("")


def contiguous_ranks(df: DataFrame, by: Sequence[str], rank: str) -> DataFrame:
    """Whether each group's ranks are exactly 1..n."""
    g = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(rank).alias("d"), F.min(rank).alias("lo"), F.max(rank).alias("hi"))
    return g.select(*by, "rows", F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("rows")) & (F.col("d") == F.col("rows")), F.lit(False)).alias("contiguous"))


def rerank_runs(reranked: DataFrame, audits: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(per query: status, whether the first changed, keys moved into and out of the top k; the run's totals).

    ``reranked(query_id, candidate_key, rank, new_rank, status)`` with status ``applied`` or a reason; what was not
    applied has no change of its first. ``audits(query_id, status)`` holds constraint audits.
    """
    applied = F.col("status") == "applied"
    g = reranked.groupBy("query_id").agg(
        F.any_value("status").alias("status"),
        F.min_by("candidate_key", "rank").alias("before"),
        F.min_by("candidate_key", "new_rank").alias("after"),
        F.count_if((F.col("new_rank") <= k) & (F.col("rank") > k)).alias("moved_in"),
        F.count_if((F.col("new_rank") > k) & (F.col("rank") <= k)).alias("moved_out"),
    )
    rows = g.select("query_id", "status", F.when(applied, F.col("before") != F.col("after")).alias("top1_changed"), "moved_in", "moved_out")
    a = audits.agg(F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(F.col("status") == "unsupported").alias("unsupported"))
    totals = rows.agg(F.count("*").alias("queries"), F.count_if(applied).alias("applicable"), F.count_if(~applied).alias("not_applicable"), F.count_if("top1_changed").alias("top1_changed"), F.count_if(~F.col("top1_changed")).alias("top1_unchanged"))
    return rows, totals.crossJoin(a)


def manual_queue(actions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Questions whose action allows no answer, to be judged by hand, with the digest of the evidence as it was.

    ``actions(query_id, route_action)``, ``evidence(query_id, rank, candidate_key)``; the audit annotates, so the digest
    is that of its input.
    """
    keys = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate_key"))), lambda x: x["candidate_key"]), "|")
    identity = evidence.groupBy("query_id").agg(F.sha2(keys, 256).alias("input_identity"))
    waiting = actions.where(~F.col("route_action").startswith("allow_"))
    return waiting.join(identity, "query_id", "left").withColumn("review_status", F.lit("pending_manual_adjudication"))
