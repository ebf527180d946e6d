"""Retrieval evaluation: gold hits, ranks, curves, paired outcomes, redundancy, failure classes, change audits.

A retrieval is long form: (query_id, method_id, rank, source_file, page_number, ...). Gold is one row per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.text import char_ngrams, norm_source, norm_text
from evidrill.operators.retrieval import numbered
from evidrill.sources.scratch import write_once


def holders(documents: DataFrame, passages: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, query_id): which documents' contents hold which passages' queries, by whole text.

    The words inside a passage, all but its first and last, are words of any text that holds it. So runs of ``words``
    of them are an equi-join key, by hash, and what meets is verified. Passages too short to have such a run are
    compared with every document; they are a stated list, sent in a broadcast that Catalyst bounds by size.
    """
    parts = lambda c: F.split(F.col(c), r"\s+")
    runs = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(words)])
    asked = passages.where("query <> ''").select("query_id", "query", parts("query").alias("w"))
    keyed = asked.where(F.size("w") >= words + 2).select("query_id", "query", runs(F.col("w"), F.lit(1)).alias("run"))
    spoken = documents.select("doc_id", parts("content").alias("w")).where(F.size("w") >= words)
    places = spoken.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: runs(F.col("w"), i)))).alias("run"))
    met = places.join(keyed, "run").select("doc_id", "query_id", "query").distinct()
    long = documents.select("doc_id", "content").join(met, "doc_id").where(F.contains("content", "query")).select("doc_id", "query_id")
    short = asked.where(F.size("w") < words + 2).select("query_id", "query")
    return long.unionByName(documents.join(short, F.contains("content", "query")).select("doc_id", "query_id"))


def first_hits(ranking: DataFrame, gold: DataFrame, by: Sequence[str] = ("query_id", "method_id"), tolerance: int = 1) -> DataFrame:
    """First rank in the gold source, on the gold page, and within the page tolerance (the page itself included)."""
    g = gold.select("query_id", norm_source("source_file").alias("gold_source"), F.col("page_number").alias("gold_page"))
    hits = ranking.join(g, "query_id").withColumn("own", norm_source("source_file") == F.col("gold_source"))
    apart = F.abs(F.col("page_number") - F.col("gold_page"))
    least = lambda c: F.min(F.when(c, F.col("rank")))
    return hits.groupBy(*by).agg(
        least(F.col("own")).alias("source_rank"),
        least(F.col("own") & (apart == 0)).alias("strict_rank"),
        least(F.col("own") & (apart <= tolerance)).alias("adjacent_rank"),
        F.count("*").alias("evidence_count"),
        F.count_if("own").alias("source_hits"),
        F.count_if(F.col("own") & (apart == 0)).alias("page_hits"),
    )


def failure_type(df: DataFrame) -> Column:
    """Why a gold page was or was not found, first match wins."""
    return (
        F.when(F.col("evidence_count") == 0, "no_evidence")
        .when(F.col("strict_rank").isNotNull(), "gold_source_page_hit")
        .when(F.col("adjacent_rank").isNotNull(), "adjacent_page_only")
        .when(F.col("source_rank").isNotNull(), "wrong_page_same_source")
        .otherwise("gold_source_absent")
    )


def retrieval_metrics(ranking: DataFrame, gold: DataFrame, tolerance: int = 1) -> DataFrame:
    """Hits, reciprocal rank, precisions and failure type of every (query, method) of the gold set."""
    ranking = write_once(ranking.select("query_id", "method_id", "rank", "source_file", "page_number"), "ranking")
    gold = write_once(gold.select("query_id", "source_file", "page_number"), "gold")
    pairs = gold.select("query_id").crossJoin(F.broadcast(ranking.select("method_id").distinct()))
    df = pairs.join(first_hits(ranking, gold, tolerance=tolerance), ["query_id", "method_id"], "left").na.fill(0, ["evidence_count", "source_hits", "page_hits"])
    ratio = lambda a: F.when(F.col("evidence_count") > 0, F.col(a) / F.col("evidence_count")).otherwise(0.0)
    hit = lambda c: F.col(c).isNotNull().cast("int")
    return df.select(
        "query_id",
        "method_id",
        hit("source_rank").alias("source_hit"),
        hit("strict_rank").alias("strict_hit"),
        hit("adjacent_rank").alias("adjacent_hit"),
        F.coalesce(1.0 / F.col("strict_rank"), F.lit(0.0)).alias("mrr"),
        ratio("source_hits").alias("source_precision"),
        ratio("page_hits").alias("page_precision"),
        failure_type(df).alias("failure_type"),
    )


def method_summary(metrics: DataFrame) -> DataFrame:
    """Mean metrics of each method."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("source_hit", "strict_hit", "adjacent_hit", "mrr", "source_precision", "page_precision")]
    return metrics.groupBy("method_id").agg(F.count("*").alias("queries"), *means)


def redundancy(evidence: DataFrame, threshold: float = 0.8, n: int = 3, smaller: bool = False, by: Sequence[str] = ("query_id", "method_id")) -> DataFrame:
    """Pairs of a query's evidence, and those at or above the threshold by Jaccard, or by the smaller set's share.

    Evidence is a short list (top 4), gathered once with its gram sets; pairs never leave the row. A pair with an empty
    side counts as a pair and is not redundant.
    """
    rows = evidence.select(*by, "rank", char_ngrams(norm_text("content"), n).alias("g"))
    sets = rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("s"))
    size = F.size("s")

    def near(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        whole = F.least(F.size(a), F.size(b)) if smaller else F.size(a) + F.size(b) - both
        return F.when(whole > 0, both >= F.lit(threshold) * whole).otherwise(False)

    after = lambda i: F.slice("s", i + 2, size)
    found = F.flatten(F.transform("s", lambda a, i: F.transform(after(i), lambda b: near(a, b))))
    return sets.select(*by, F.size(found).alias("pairs"), F.size(F.filter(found, lambda x: x)).alias("redundant_pairs"))


def redundancy_rates(pairs: DataFrame, by: Sequence[str] = ("method_id",)) -> DataFrame:
    """A3: The ratio of sums and the mean of ratios, which differ and are both reported."""
    own = F.when(F.col("pairs") > 0, F.col("redundant_pairs") / F.col("pairs")).otherwise(0.0)
    total = F.when(F.sum("pairs") > 0, F.sum("redundant_pairs") / F.sum("pairs")).otherwise(0.0)
    return pairs.groupBy(*by).agg(total.alias("ratio_of_sums"), F.avg(own).alias("mean_of_ratios"))


def anchor_coverage(evidence: DataFrame, gold: DataFrame, n: int = 3) -> DataFrame:
    """Most of the gold anchor's gram set that one piece of evidence holds."""
    g = gold.select("query_id", char_ngrams(norm_text("anchor_text_span"), n).alias("anchor"))
    e = evidence.select("query_id", "method_id", char_ngrams(norm_text("content"), n).alias("own")).join(g, "query_id")
    share = F.when(F.size("anchor") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("anchor", "own")) / F.size("anchor"))
    return e.groupBy("query_id", "method_id").agg(F.max(share).alias("coverage"))


def budget_curve(rankings: DataFrame, gold: DataFrame, budgets: Sequence[int], tolerance: int = 1) -> DataFrame:
    """Per method and budget: strict hits, recall, mean reciprocal rank, and queries first hit at this budget.

    ``rankings`` holds a ranking for each budget (column budget).
    """
    hits = first_hits(rankings, gold, by=("query_id", "method_id", "budget"), tolerance=tolerance)
    grid = gold.select("query_id").crossJoin(F.broadcast(rankings.select("method_id").distinct())).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    df = grid.join(hits.select("query_id", "method_id", "budget", "strict_rank"), ["query_id", "method_id", "budget"], "left")
    hit = F.col("strict_rank").isNotNull()
    df = df.withColumn("first_budget", F.min(F.when(hit, F.col("budget"))).over(Window.partitionBy("query_id", "method_id")))
    return df.groupBy("method_id", "budget").agg(F.count("*").alias("queries"), F.count_if(hit).alias("strict_hits"), F.avg(hit.cast("int")).alias("strict_recall"), F.avg(F.coalesce(1.0 / F.col("strict_rank"), F.lit(0.0))).alias("mrr"), F.count_if(F.col("first_budget") == F.col("budget")).alias("new_hits"))


def paired_counts(metrics: DataFrame, left: str, right: str, hit: str = "strict_hit") -> DataFrame:
    """Added, lost, both and neither between two methods over the same queries."""
    a, b = (metrics.where(F.col("method_id") == m).select("query_id", F.col(hit).alias(c)) for m, c in ((left, "l"), (right, "r")))
    of = lambda x, y: F.count_if((F.col("l") == x) & (F.col("r") == y))
    return a.join(b, "query_id").agg(of(0, 1).alias("added"), of(1, 0).alias("lost"), of(1, 1).alias("both"), of(0, 0).alias("neither"))


def freeze_candidate(candidate_gain: Column, final_gain: Column) -> Column:
    """A method is frozen if its candidate recall rises and its final recall does not fall."""
    return (candidate_gain > 0) & (final_gain >= 0)


def route_union(routed: DataFrame, priority: Sequence[str]) -> DataFrame:
    """One row per (query, candidate): the routes that found it in order of priority, and where it stands in the union."""
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("method_id"))
    rows = routed.where(at > 0).select("query_id", "candidate_key", F.struct(at.alias("p"), F.col("rank").alias("r"), F.col("method_id").alias("m")).alias("x"))
    g = rows.groupBy("query_id", "candidate_key").agg(F.min("x").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["m"]), ",").alias("routes"))
    w = Window.partitionBy("query_id").orderBy("first.p", "first.r", "candidate_key")
    return g.select("query_id", "candidate_key", "routes", F.col("first.m").alias("first_route"), F.row_number().over(w).alias("union_rank"))


def failure_taxonomy(routed: DataFrame, gold: DataFrame, dense: str = "dense", sparse: str = "sparse", fused: str = "rrf", tolerance: int = 1) -> DataFrame:
    """Class of each query whose gold page the fusion misses; the page itself is not its own neighbour here."""
    g = gold.select("query_id", F.lower("source_file").alias("gold_source"), F.col("page_number").alias("gold_page"))
    df = routed.join(g, "query_id", "right").withColumn("own", F.lower("source_file") == F.col("gold_source"))
    d = F.abs(F.col("page_number") - F.col("gold_page"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    at = lambda m: F.col("own") & (d == 0) & (F.col("method_id") == m)
    f = df.groupBy("query_id").agg(any_of(at(dense)).alias("dense"), any_of(at(sparse)).alias("sparse"), any_of(at(fused)).alias("fused"), any_of(F.col("own") & (d > 0) & (d <= tolerance)).alias("near"), any_of(F.col("own")).alias("source"))
    kind = (
        F.when(F.col("fused"), "hit")
        .when(F.col("dense"), "fusion_dropped_valid_dense")
        .when(F.col("sparse"), "fusion_dropped_valid_sparse")
        .when(F.col("near"), "adjacent_page")
        .when(F.col("source"), "wrong_page_same_source")
        .otherwise("source_absent")
    )
    return f.select("query_id", kind.alias("failure"))


def source_pages(routed: DataFrame) -> DataFrame:
    """Candidates of a page as one: the first of them, how many, and all in rank order."""
    x = F.struct("rank", "candidate_key")
    return routed.groupBy("query_id", "method_id", "source_file", "page_number").agg(F.min(x)["candidate_key"].alias("candidate_key"), F.min("rank").alias("rank"), F.count("*").alias("members"), F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda y: y["candidate_key"]), ",").alias("member_keys"))


def source_crowding(routed: DataFrame) -> DataFrame:
    """Distinct sources of a ranking, and the largest one's count and share."""
    per = routed.groupBy("query_id", "method_id", "source_file").agg(F.count("*").alias("n"))
    return per.groupBy("query_id", "method_id").agg(F.count("*").alias("unique_sources"), F.max("n").alias("max_per_source"), (F.max("n") / F.sum("n")).alias("max_share"))


def change_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query: did membership or only order of the evidence change, and how many keys came and went."""
    side = lambda df, p: df.select("query_id", "candidate_key", F.col("rank").alias(p))
    df = side(before, "b").join(side(after, "a"), ["query_id", "candidate_key"], "full_outer")
    g = df.groupBy("query_id").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
    return g.withColumn("change", F.when(F.col("added") + F.col("removed") > 0, "membership").when(F.col("moved") > 0, "order_only").otherwise("unchanged"))


def score_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], score: str, tolerance: float) -> DataFrame:
    """Shared keys, median and greatest absolute difference of a score, and how many exceed the tolerance."""
    d = left.select(*keys, F.col(score).alias("l")).join(right.select(*keys, F.col(score).alias("r")), list(keys)).select(F.abs(F.col("l") - F.col("r")).alias("d"))
    return d.agg(F.count("*").alias("shared"), F.percentile("d", F.lit(0.5)).alias("median_diff"), F.max("d").alias("max_diff"), F.count_if(F.col("d") > tolerance).alias("over_tolerance"))


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A4: Minimum, median, nearest-rank 95th percentile, maximum and mean.

    The nearest rank ceil(0.95 n) and the middle ones are places in ranges of the values, so no group, however few there
    are, is sorted in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n_values"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"))
    n = F.col("n_values")
    wanted = whole.select(*by, F.floor((n + 1) / 2).alias("_a"), F.floor((n + 2) / 2).alias("_b"), F.ceil(n * 0.95).alias("_c")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    at = numbered(rows, [F.col("_v")], by, "_place").join(wanted, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).where("_place IN (_a, _b, _c)")
    pick = lambda c: F.max(F.when(F.col("_place") == F.col(c), F.col("_v")))
    ranks = at.groupBy(*by).agg(((pick("_a") + pick("_b")) / 2).alias("median"), pick("_c").alias("p95")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    out = whole.join(ranks, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return out.select(*by, "n_values", "min", "median", "p95", "max", "mean")


def output_risk_flags(outputs: DataFrame, refusal: Sequence[str], unsafe: Sequence[str], protective: Sequence[str], claims: Sequence[str]) -> DataFrame:
    """Heuristic flags of an answer: refusal, its correctness, an unsupported claim without snippets, an unsafe answer."""
    from evidrill.functions.text import contains_any

    refuses = contains_any("answer", refusal, ignore_case=True)
    should = F.col("expected_decision").isin("insufficient_evidence", "boundary_refusal")
    claim = contains_any("answer", claims, ignore_case=True) & (F.col("snippet_count") == 0)
    danger = contains_any("answer", unsafe, ignore_case=True) & ~contains_any("answer", protective, ignore_case=True) & should
    return outputs.select("*", refuses.alias("refuses"), (refuses == should).alias("refusal_correct"), (claim & ~refuses).alias("unsupported_claim"), danger.alias("unsafe_answer"))


def usage_totals(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Tokens and cost of each method; prices are per million tokens."""
    cost = F.round((F.sum("input_tokens") * F.lit(price_in) + F.sum("output_tokens") * F.lit(price_out)) / 1e6, 8)
    return calls.groupBy("method_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), cost.alias("cost"))


def rank_outcome(before: Column, after: Column) -> Column:
    """Improved, unchanged, worsened or not applicable; a missing rank is worse than any."""
    none = before.isNull() & after.isNull()
    better = (before.isNull() & after.isNotNull()) | (after < before)
    worse = (after.isNull() & before.isNotNull()) | (after > before)
    return F.when(none, "not_applicable").when(better, "improved").when(worse, "worsened").otherwise("unchanged")


def strict_effects(before: DataFrame, after: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """What a change of ranking did to each query's gold page, and the direction of its reciprocal rank.

    Both sides are (query_id, strict_rank), null where the page is not found.
    """
    l, r = before.select("query_id", F.col("strict_rank").alias("b")), after.select("query_id", F.col("strict_rank").alias("a"))
    df = l.join(r, "query_id")
    delta = F.coalesce(1.0 / F.col("a"), F.lit(0.0)) - F.coalesce(1.0 / F.col("b"), F.lit(0.0))
    effect = F.when(F.col("b").isNull() & F.col("a").isNotNull(), "strict_hit_added").when(F.col("b").isNotNull() & F.col("a").isNull(), "strict_hit_lost").when(F.col("a") < F.col("b"), "strict_rank_improved").when(F.col("a") > F.col("b"), "strict_rank_worsened").otherwise("strict_metric_unchanged")
    direction = F.when(delta > epsilon, "positive").when(delta < -epsilon, "negative").otherwise("zero")
    return df.select("query_id", effect.alias("effect"), delta.alias("mrr_delta"), direction.alias("direction"))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every candidate of either ranking with both ranks, their difference, and whether it came, went or stayed."""
    side = lambda df, p: df.select("query_id", "candidate_key", F.col("rank").alias(p))
    df = side(before, "rank_before").join(side(after, "rank_after"), ["query_id", "candidate_key"], "full_outer")
    kind = F.when(F.col("rank_before").isNull(), "added").when(F.col("rank_after").isNull(), "removed").when(F.col("rank_before") == F.col("rank_after"), "same").otherwise("moved")
    return df.withColumn("rank_delta", F.col("rank_before") - F.col("rank_after")).withColumn("membership", kind)


def budget_replacement(before: DataFrame, after: DataFrame, evidence: DataFrame, gold: DataFrame, budget: int) -> DataFrame:
    """Per gold query, was its page gained or lost when a budget made room, by what mechanism, and what gained it.

    ``before(query_id, candidate_key, source_file, page_number, rank)`` with cached ranks, ``after`` and ``evidence``
    the pool and the final evidence of the other method. A loss is the replacement's if a gold candidate that it removed
    would have stood within the budget. A gain is by an added candidate, by a promoted one, or other.
    """
    g = gold.select("query_id", F.lower("source_file").alias("gs"), F.col("page_number").alias("gp"))
    on = lambda df: df.join(g, "query_id").where((F.lower("source_file") == F.col("gs")) & (F.col("page_number") == F.col("gp")))
    b, a, e = on(before), on(after), on(evidence)
    flag = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    gone = b.join(after.select("query_id", "candidate_key"), ["query_id", "candidate_key"], "left_anti").groupBy("query_id").agg(F.min("rank").alias("removed_best_rank"))
    new = flag(e.join(before.select("query_id", "candidate_key"), ["query_id", "candidate_key"], "left_anti"), "added_gold")
    df = g.select("query_id")
    for part in (flag(b, "before_hit"), flag(a, "after_hit"), flag(e, "evidence_hit"), new, gone):
        df = df.join(part, "query_id", "left")
    df = df.na.fill(False)
    outcome = F.when(F.col("before_hit") & F.col("after_hit"), "both").when(F.col("before_hit"), "lost").when(F.col("after_hit"), "added").otherwise("neither")
    loss = F.when(F.col("before_hit") & ~F.col("after_hit"), F.when(F.col("removed_best_rank") <= budget, "pre_rerank_budget_replacement").otherwise("unresolved"))
    gain = F.when(F.col("evidence_hit"), F.when(F.col("added_gold"), "graph_added_gold_selected").when(F.col("before_hit") & F.col("after_hit"), "baseline_gold_promoted_after_replacement").otherwise("other"))
    return df.select("query_id", outcome.alias("outcome"), loss.alias("loss_mechanism"), gain.alias("gain_attribution"), "removed_best_rank")


def recovery_metrics(evidence: DataFrame, status: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5: (hits, rank and reciprocal rank of each query's recovered evidence, recalls and the share that found too little).

    ``evidence(query_id, rank, source_file, page_number)``, ``status(query_id, retrieval_status)``.
    """
    hits = first_hits(evidence.withColumn("method_id", F.lit("recovery")), gold).drop("method_id")
    df = gold.select("query_id").join(hits, "query_id", "left").join(status, "query_id", "left")
    found = lambda c: F.col(c).isNotNull()
    rows = df.select("query_id", "retrieval_status", found("source_rank").alias("source_hit"), found("strict_rank").alias("strict_hit"), found("adjacent_rank").alias("adjacent_hit"), "strict_rank", F.coalesce(1.0 / F.col("strict_rank"), F.lit(0.0)).alias("reciprocal_rank"))
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    short = F.coalesce(F.col("retrieval_status") == "insufficient_evidence", F.lit(False))
    return rows, rows.agg(F.count("*").alias("queries"), share(F.col("source_hit")).alias("source_recall"), share(F.col("strict_hit")).alias("strict_recall"), share(F.col("adjacent_hit")).alias("adjacent_recall"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"), share(short).alias("insufficient_rate"))


def method_evaluation(candidates: DataFrame, final: DataFrame, gold: DataFrame, latencies: DataFrame) -> DataFrame:
    """Per method, recalls and reciprocal rank of its candidates, recalls of its final evidence, sizes and latency.

    ``candidates`` and ``final`` are (query_id, method_id, rank, source_file, page_number), cut to their depths;
    ``latencies(query_id, method_id, seconds)`` may lack some queries, which the mean leaves out.
    """
    c, f = retrieval_metrics(candidates, gold), retrieval_metrics(final, gold)
    left = c.groupBy("method_id").agg(F.count("*").alias("queries"), F.avg("source_hit").alias("candidate_source"), F.avg("strict_hit").alias("candidate_strict"), F.avg("mrr").alias("candidate_mrr"))
    right = f.groupBy("method_id").agg(*[F.avg(f"{m}_hit").alias(f"final_{m}") for m in ("source", "strict", "adjacent")])
    sizes = [df.join(gold.select("query_id"), "query_id").groupBy("method_id").agg((F.count("*") / F.count_distinct("query_id")).alias(name)) for df, name in ((candidates, "mean_candidates"), (final, "mean_evidence"))]
    took = latencies.join(gold.select("query_id"), "query_id").groupBy("method_id").agg(F.avg("seconds").alias("mean_seconds"))
    out = left.join(right, "method_id")
    for part in (*sizes, took):
        out = out.join(part, "method_id", "left")
    return out
