"""Retrieval over whole batches of queries: candidate routes, fusion, rerank, dedup, trust.

Long form throughout: one row per (query, candidate, route). Texts join late, after ranks are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.rules import FALLBACKS, fallback_relevance, is_broad_review, has_safety_signal, required_terms_state
from evidrill.functions.text import char_ngrams, contains_any, dedup_signature, norm_text, norm_ws
from evidrill.sources.scratch import write_once

#: Queries and vectors that meet in one matrix product.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows within groups by a total order; with ``k``, keep the first (planned as a partial group limit)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Places 1.. of all rows, or of each large group, in a total order, with no group in one task.

    Rows are dealt by ranges of the order and written once; a row's place is that within its range, and the rows of its
    group in the ranges before.
    """
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    dealt = keyed.repartitionByRange(*[F.col(c) for c in by], *order)
    ranges = write_once(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range", *by).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", *by, before.alias("_start")).withColumnsRenamed({c: f"_by_{c}" for c in ("_range", *by)})
    inside = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    placed = ranges.withColumn("_inside", inside).join(starts, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in ("_range", *by)])
    return placed.withColumn(name, (F.col("_inside") + F.col("_start")).cast("int" if not by else "long")).select(*df.columns, name)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance of two arrays in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _packed(df: DataFrame, key: str, vector: str, rows: int, by: str | None = None) -> DataFrame:
    """Rows (keys, matrix[, by]) of up to ``rows`` vectors each: a block's vectors as doubles, one after the other."""
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[tuple[object, np.ndarray]]] = {}

        def block(name: object, own: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
            names = {"by": pa.array([name], pa.string())} if by else {}
            return pa.RecordBatch.from_pydict({"keys": pa.array([[k for k, _ in own]], pa.list_(keys)), "matrix": pa.array([np.stack([v for _, v in own]).tobytes()], pa.binary()), **names})

        for b in batches:
            keys = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                name = row[2] if by else None
                own = held.setdefault(name, [])
                own.append((row[0], np.array(row[1], dtype="<f8")))
                if len(own) == rows:
                    yield block(name, held.pop(name))
        for name, own in held.items():
            yield block(name, own)

    columns = [F.col(key), F.col(vector).cast("array<double>"), *([F.col(by).cast("string")] if by else [])]
    return df.select(*columns).mapInArrow(pack, f"keys array<{kind}>, matrix binary" + (", by string" if by else ""))


def _nearest(k: int):
    """The k nearest rows of each block of vectors to each query of a block, by exact distance, then key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, qs, keys, xs, name in zip(*(c.to_pylist() for c in b.columns)):
                q, x = (np.frombuffer(m, "<f8").reshape(len(n), -1) for m, n in ((qs, ids), (xs, keys)))
                square = (x**2).sum(1)
                near = square - 2 * (q @ x.T) + (q**2).sum(1)[:, None]  # good enough to leave out what is far
                slack = 1e-9 * (square.max() + (q**2).sum(1))
                bound = np.partition(near, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1] + slack
                out = []
                for i, at in enumerate(near <= bound[:, None]):
                    at = np.flatnonzero(at)
                    d = ((x[at] - q[i]) ** 2).sum(1)
                    out += [(ids[i], name, keys[j], v) for v, j in sorted(zip(d.tolist(), at.tolist()), key=lambda t: (t[0], keys[t[1]]))[:k]]
                c = list(zip(*out))
                yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.float64())], names=["query_id", "collection", "candidate_key", "distance"])

    return run


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours: (query_id, collection, candidate_key, distance, raw_score, route_rank, route).

    ``vectors(candidate_key, collection, embedding)``, ``queries(query_id, query_vector)``. A stated set of queries
    meets all vectors in blocks: each pair of a block of either is one matrix product that leaves k rows a query and
    collection. Nothing is collected; Catalyst broadcasts the blocks of queries if they are small. Distances are squared
    sums of differences in double precision, ties go to the lesser key.
    """
    q = _packed(queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector"), "query_id", "query_vector", QUERY_BLOCK).select(F.col("keys").alias("ids"), F.col("matrix").alias("asked"))
    x = _packed(vectors.select(F.col("candidate_key").cast("string").alias("candidate_key"), "embedding", "collection"), "candidate_key", "embedding", VECTOR_BLOCK, "collection")
    pairs = x.crossJoin(q).select("ids", "asked", "keys", "matrix", "by")
    found = pairs.mapInArrow(_nearest(k), "query_id long, collection string, candidate_key string, distance double")
    top = ranked(found, ["query_id", "collection"], [F.col("distance"), F.col("candidate_key")], k, "route_rank")
    return top.withColumn("raw_score", 1 - F.col("distance")).withColumn("route", F.concat(F.lit("dense_exact:"), "collection"))


def check_weights(postings: DataFrame, vocabulary: int) -> DataFrame:
    """Postings without zeros; a token outside the vocabulary stops the job."""
    bad = (F.col("token_id") < 0) | (F.col("token_id") >= vocabulary)
    return postings.where("weight <> 0").withColumn("token_id", F.when(bad, F.raise_error(F.lit("token id out of range")).cast("int")).otherwise(F.col("token_id")))


def sparse_top_k(documents: DataFrame, queries: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Learned-sparse retrieval: dot products above 0 over shared tokens, ties by key.

    ``documents(candidate_key, token, weight, *by)``, ``queries(query_id, token, weight)``. An equi-join on the token;
    the aggregate combines before the shuffle and the group limit cuts before the sort.
    """
    q = queries.select("query_id", "token", F.col("weight").cast("double").alias("query_weight"))
    dots = documents.join(q, "token").groupBy("query_id", *by, "candidate_key").agg(F.sum(F.col("weight").cast("double") * F.col("query_weight")).alias("raw_score"))
    return ranked(dots.where("raw_score > 0"), ["query_id", *by], [F.col("raw_score").desc(), F.col("candidate_key")], k, "route_rank")


def term_weights(df: DataFrame, key: str, token_array: Column) -> DataFrame:
    """(key, token, weight): the deterministic stand-in for a learned-sparse encoder, by term frequency."""
    return df.select(key, F.explode(token_array).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("weight"))


def rrf(routed: DataFrame, k: int = 60, top_k: int | None = None, by: Sequence[str] = ("query_id",), key: Sequence[str] = ("candidate_key",)) -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(k+rank) in rank order, with the number of routes and the route trace.

    The sum runs over a sorted array, so it is the same for every partitioning.
    """
    trace = F.sort_array(F.collect_list(F.struct("route", "route_rank", "raw_score")))
    terms = F.sort_array(F.transform(F.col("route_traces"), lambda t: 1.0 / (t["route_rank"] + F.lit(float(k)))))
    fused = routed.groupBy(*by, *key).agg(trace.alias("route_traces")).withColumn("rrf_score", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    return ranked(fused.withColumn("n_routes", F.size("route_traces")), by, [F.col("rrf_score").desc(), *[F.col(c) for c in key]], top_k)


def rrf_pages(routed: DataFrame, k: int = 60) -> DataFrame:
    """Fusion keyed by (query, source, page): every occurrence scores; the representative has the highest final score."""
    best = F.max_by(F.struct("candidate_key", "final_score"), F.struct(F.col("final_score"), (-F.col("route_rank")).alias("r"), F.col("candidate_key")))
    fused = routed.groupBy("query_id", "source_file", "page_number").agg(F.aggregate(F.sort_array(F.collect_list(1.0 / (F.lit(float(k)) + F.col("route_rank")))), F.lit(0.0), lambda a, x: a + x).alias("rrf_score"), best.alias("best"), F.count("*").alias("members"))
    fused = fused.select("query_id", "source_file", "page_number", "rrf_score", "members", "best.candidate_key", "best.final_score")
    return ranked(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("final_score").desc(), F.col("source_file"), F.col("page_number")])


def fuse_methods(routed: DataFrame, methods: dict[str, Sequence[str]], k: int = 60, top_k: int = 20) -> DataFrame:
    """Fusion for several methods at once; each takes the routes that begin with one of its prefixes."""
    of = F.array_compact(F.array(*[F.when(reduce(Column.__or__, [F.col("route").startswith(p) for p in prefixes]), F.lit(m)) for m, prefixes in methods.items()]))
    return rrf(routed.withColumn("method_id", F.explode(of)), k, top_k, by=("query_id", "method_id"))


def budget_fusion(routed: DataFrame, budgets: Sequence[int], k: int = 60) -> DataFrame:
    """Fusion recomputed from the prefix of every route for each candidate budget."""
    wide = routed.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("route_rank <= budget")
    return rrf(wide, k, by=("query_id", "budget")).where("rank <= budget")


def rerank(pool: DataFrame, score: Column, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Ranks before and after a plug-in scorer: (-rrf, key), then (-score, -rrf, key)."""
    before = ranked(pool.withColumn("rerank_score", score), by, [F.col("rrf_score").desc(), F.col("candidate_key")], name="pre_rerank_rank")
    return ranked(before, by, [F.col("rerank_score").desc(), F.col("rrf_score").desc(), F.col("candidate_key")], name="post_rerank_rank")


def lexical_scorer(query: str, content: str) -> Column:
    """Offline stand-in for a cross-encoder: share of the query's character trigrams that the content holds."""
    a, b = char_ngrams(norm_text(query)), char_ngrams(norm_text(content))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def model_scorer(predict: Callable[[list[tuple[str, str]]], Sequence[float]]) -> Callable[[str, str], Column]:
    """A cross-encoder as a vectorised column: ``predict`` gets batches of (query, content) pairs."""

    @F.pandas_udf("double")
    def score(q: pd.Series, c: pd.Series) -> pd.Series:
        out = list(predict(list(zip(q, c))))
        if len(out) != len(q):
            raise ValueError("the scorer returned another number of scores than pairs")
        return pd.Series(out, dtype="float64")

    return lambda query, content: score(F.col(query), F.col(content))


def greedy_dedup(pool: DataFrame, threshold: float = 0.8, limit: int = 4, n: int = 3, order: str = "rank", by: Sequence[str] = ("query_id",), texts: DataFrame | None = None) -> DataFrame:
    """Order-dependent evidence dedup, one fold per query inside the JVM.

    A row is skipped if its provenance is invalid, if its normalised text equals an admitted one, or if an admitted
    row of the same source and page shares at least ``threshold`` of the smaller gram set; the fold admits ``limit``.
    The pool of a query is a top-k list with distinct ranks, so the collected array is small by construction; it holds
    digests and the ranks that a row is near to, no texts.

    ``texts(candidate_key, source_file, page_number, content)`` may hold the candidates' texts once; else the pool has
    those columns. A text is normalised once, however many queries it answers, and grams are only made of texts that
    meet another one of their page.
    """
    on = [*by, "candidate_key"] if texts is None else ["candidate_key"]
    pool = pool if texts is None else write_once(pool.select(*by, "candidate_key", order), "dedup-keys")
    own = (pool if texts is None else texts.join(pool.select("candidate_key").distinct(), "candidate_key", "left_semi")).select(*on, "source_file", "page_number", "content")
    valid = (F.coalesce(F.trim("source_file"), F.lit("")) != "") & F.coalesce(F.col("page_number") > 0, F.lit(False))
    # written before the join, which would digest a text anew for each of its rows
    told = write_once(own.select(*on, "source_file", "page_number", F.sha2(norm_text("content"), 256).alias("digest"), valid.alias("valid")), "digests")
    rows = write_once(pool.select(*by, "candidate_key", F.col(order).alias("o")).join(told, on), "dedup-pool")
    left = rows.select(*by, "source_file", "page_number", F.col("o").alias("lo"), F.col("candidate_key").alias("lk"), F.col("digest").alias("ld"))
    pairs = write_once(rows.join(left, [*by, "source_file", "page_number"]).where("lo < o AND ld <> digest").select(*by, "o", "lo", "candidate_key", "lk"), "page-pairs")
    met = pairs.select(*on).unionByName(pairs.select(*[F.col("lk").alias(c) if c == "candidate_key" else F.col(c) for c in on])).distinct()
    grams = own.join(met, on, "left_semi").select(*on, char_ngrams(norm_text("content"), n).alias("g"))
    pairs = pairs.join(grams, on).join(grams.withColumnsRenamed({"candidate_key": "lk", "g": "lg"}), [c if c != "candidate_key" else "lk" for c in on])
    least = F.least(F.size("lg"), F.size("g"))
    near = pairs.where((least > 0) & (F.size(F.array_intersect("lg", "g")) >= F.lit(threshold) * least)).groupBy(*by, "o").agg(F.collect_set("lo").alias("near"))
    row = F.struct("o", F.col("candidate_key").alias("k"), F.col("digest").alias("t"), F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("near"), F.col("valid").alias("v"))
    pools = rows.join(near, [*by, "o"], "left").groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = pools.schema["rows"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["kept"]) >= limit
        same = F.exists(acc["kept"], lambda a: a["t"] == x["t"])
        close = F.exists(acc["kept"], lambda a: F.array_contains(x["near"], a["o"]))
        one = lambda c: c.cast("int")
        skip = ~x["v"]
        return F.struct(
            F.when(full | skip | same | close, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
            (acc["seen"] + one(~full)).alias("seen"),
            (acc["invalid"] + one(~full & skip)).alias("invalid"),
            (acc["exact"] + one(~full & ~skip & same)).alias("exact"),
            (acc["overlap"] + one(~full & ~skip & ~same & close)).alias("overlap"),
        )

    zero = F.struct(F.array().cast(kind).alias("kept"), *[F.lit(0).alias(c) for c in ("seen", "invalid", "exact", "overlap")])
    return pools.withColumn("r", F.aggregate("rows", zero, step)).select(*by, F.posexplode_outer("r.kept").alias("i", "x"), "r.seen", "r.invalid", "r.exact", "r.overlap").select(*by, (F.col("i") + 1).alias("evidence_rank"), F.col("x.k").alias("candidate_key"), "seen", "invalid", "exact", "overlap")


def admit_evidence(pool: DataFrame, limit: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Evidence admission with reasons, in order: provenance, bare title, repeated text, over the cap; counting goes on."""
    text = norm_text("content")
    bad = (F.coalesce(F.trim("source_file"), F.lit("")) == "") | F.coalesce(F.col("page_number") <= 0, F.lit(True))
    title = (text != "") & (text == norm_text(F.regexp_replace("source_file", r"\.[^.]*$", "")))
    df = pool.withColumn("reason", F.when(bad, "invalid_provenance").when(title, "title_only"))
    df = df.withColumn("t", text).withColumn("nth", F.row_number().over(Window.partitionBy(*by, "t", F.col("reason").isNull()).orderBy("rank")))
    df = df.withColumn("reason", F.coalesce("reason", F.when(F.col("nth") > 1, "duplicate")))
    df = df.withColumn("place", F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy(*by).orderBy("rank")))
    return df.withColumn("reason", F.coalesce("reason", F.when(F.col("place") > limit, "over_limit").otherwise("admitted"))).drop("t", "nth", "place")


def lexical_fallback(chunks: DataFrame, queries: DataFrame, limit: int = 3, rules=FALLBACKS) -> DataFrame:
    """Chunks bound to the source of a triggered rule, the best max(2, min(4, limit)) of each rule and query."""
    per_rule = max(2, min(4, limit))
    # what a rule finds does not hang on the question, so the best of each rule are known before questions join them
    parts = [chunks.where(F.col("source_file") == rule[1]).withColumn("relevance_score", fallback_relevance(rule, "content")).where("relevance_score IS NOT NULL").withColumn("rule", F.lit(i)) for i, rule in enumerate(rules)]
    scored = reduce(DataFrame.unionByName, parts).withColumn("distance", 1 / F.col("relevance_score") - 1)
    best = ranked(scored, ["rule"], [F.col("relevance_score").desc(), F.col("granularity"), F.col("candidate_key")], per_rule, "fallback_rank")
    asked = F.array_compact(F.array(*[F.when(contains_any("query", triggers), F.lit(i)) for i, (triggers, _, _) in enumerate(rules)]))
    return best.join(queries.select("query_id", F.explode(asked).alias("rule")), "rule")


def required_term_filter(scored: DataFrame) -> DataFrame:
    """Keep what names every drug that the query names; broad reviews add safety principles, or keep all if nothing is left."""
    needed, met = required_terms_state("query", "content")
    df = scored.withColumn("needed", needed).withColumn("met", met).withColumn("broad", is_broad_review("query"))
    df = df.withColumn("any_met", F.max("met").over(Window.partitionBy("query_id")))
    keep = ~F.col("needed") | F.col("met") | (F.col("broad") & (~F.col("any_met") | has_safety_signal("content")))
    # with the union, chunks that meet the terms come first and principles follow
    return df.where(keep).withColumn("filter_class", F.when(~F.col("needed") | F.col("met") | ~F.col("any_met"), 0).otherwise(1)).drop("needed", "met", "broad", "any_met")


def first_by_signature(scored: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row of each (query, source, page, signature) in score order."""
    keyed = scored.withColumn("signature", dedup_signature("content"))
    return ranked(keyed, ["query_id", "source_file", "page_number", "signature"], order, 1, "nth").drop("nth", "signature")


def neighbour_pages(seeds: DataFrame, pages: DataFrame, radius: int = 1) -> DataFrame:
    """Pages around seeds in seed order, then by offset; the first seed that reaches a page has it; seeds are left out."""
    offsets = [o for o in range(-radius, radius + 1) if o]
    near = seeds.select("query_id", "source_file", F.col("page_number").alias("seed_page"), "seed_rank", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")).withColumn("page_number", F.col("seed_page") + F.col("offset"))
    found = near.join(pages, ["source_file", "page_number"]).join(seeds.select("query_id", "source_file", "page_number"), ["query_id", "source_file", "page_number"], "left_anti")
    return ranked(found, ["query_id", "source_file", "page_number"], [F.col("seed_rank"), F.col("offset"), F.col("candidate_key")], 1, "nth").drop("nth")


def evidence_window(seeds: DataFrame, neighbours: DataFrame, final_k: int = 4, per_seed: int = 1) -> DataFrame:
    """Seeds in rank order, each followed by at most ``per_seed`` of its neighbours; the first ``final_k`` a query.

    ``seeds(query_id, source_file, page_number, candidate_key, seed_rank)`` and ``neighbours``, the rows of
    ``neighbour_pages`` over the same seeds with ``overlap``, the question's share of characters: greatest first, then
    nearest, then the page before. A page that is a seed again gives its next neighbours there.
    """
    page = ["query_id", "source_file", "seed_page"]
    turns = ranked(seeds.withColumnRenamed("page_number", "seed_page"), page, [F.col("seed_rank"), F.col("candidate_key")], name="turn")
    columns = ["query_id", "source_file", "page_number", "candidate_key", "seed_rank", "nth"]
    out = turns.where("turn = 1").withColumnsRenamed({"seed_page": "page_number"}).withColumn("nth", F.lit(0)).select(columns)
    if per_seed > 0:
        near = ranked(neighbours.drop("seed_rank"), page, [F.col("overlap").desc(), F.abs("offset"), F.col("offset")], name="nth")
        near = near.withColumn("turn", F.floor((F.col("nth") - 1) / per_seed).cast("int") + 1)
        out = out.unionByName(near.join(turns.select(*page, "turn", "seed_rank"), [*page, "turn"]).select(columns))
    return ranked(out.withColumn("is_neighbor", F.col("nth") > 0), ["query_id"], [F.col("seed_rank"), F.col("nth")], final_k, "position").drop("nth")


def distinct_profiles(tasks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Logical tasks with the key of the one physical retrieval that serves all tasks of equal profile."""
    return tasks.withColumn("physical_key", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256))


def granularities_of(intent: Column) -> Column:
    """Detail questions go to the finest chunks, concept questions to the middle, all else to all three."""
    return F.when(intent == "DETAIL", F.array(F.lit(128))).when(intent == "CONCEPT", F.array(F.lit(512))).otherwise(F.array(F.lit(128), F.lit(512), F.lit(1024)))


def trust_score(s_ret: Column, s_faith: Column, weight: Column, alpha: float = 0.4, beta: float = 0.6, high: float = 7.5, low: float = 5.0) -> tuple[Column, Column]:
    """(score, level) from clamped parts: the weighted sum times the authority, and its gate."""
    clamp = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), x))
    score = F.round((F.lit(alpha) * clamp(s_ret, 10) + F.lit(beta) * clamp(s_faith, 10)) * clamp(weight, 1), 4)
    return score, F.when(score >= high, "TRUSTED").when(score > low, "WARNING").otherwise("REJECTED")


def index_ready(found: DataFrame, complete: DataFrame) -> DataFrame:
    """Results, or none of them where the index's completeness table has a gap."""
    return found.join(F.broadcast(complete.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("ready"))), F.col("ready")).drop("ready")


def evidence_snippets(evidence: DataFrame, count: int, chars: int, order: str = "evidence_rank") -> DataFrame:
    """The prompt's evidence: the first ``count`` rows cut to ``chars``; empty texts drop out after the cut."""
    top = evidence.where(F.col(order) <= count).withColumn("snippet", F.substring(norm_ws("content"), 1, chars))
    return top.where("snippet <> ''")


def evidence_view(evidence: DataFrame) -> DataFrame:
    """evidence with the names that a user sees: source, page and text instead of the index's own."""
    shown = {"source_file": "source", "page_number": "page", "content": "text"}
    return evidence.withColumnsRenamed({k: v for k, v in shown.items() if k in evidence.columns})
