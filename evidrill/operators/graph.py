"""Constraint graph over evidence: postings, path qualification, quota routing, expansion, rerank, audits.

Constraints are one long table (owner_id, scope, ctype, cvalue); an inverted index is that table joined on (ctype,
cvalue), and every set comparison is an aggregate over matched rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.constraints import BROAD_CONTENT, EXCLUSIVE_IN_CLAIMS, EXCLUSIVE_IN_RERANK, SPECIFIC_ANCHORS, STRONG_ANCHORS, values_conflict, values_match
from evidrill.operators.retrieval import ranked


def postings(constraints: DataFrame) -> DataFrame:
    """(ctype, cvalue, candidates): how many candidates stand under each key of the index."""
    return constraints.where("scope = 'context'").groupBy("ctype", "cvalue").agg(F.count_distinct("owner_id").alias("candidates"))


def adjacent_pages(candidates: DataFrame) -> DataFrame:
    """Pages of a source that have a neighbour at a distance of one."""
    pages = candidates.select("source_file", "page_number").distinct()
    w = Window.partitionBy("source_file").orderBy("page_number")
    near = pages.withColumn("before", F.lag("page_number").over(w)).withColumn("after", F.lead("page_number").over(w))
    keep = lambda c, d: F.when(F.col(c) == F.col("page_number") + d, F.col(c))
    return near.select("source_file", "page_number", keep("before", -1).alias("before"), keep("after", 1).alias("after"))


def posting_ranking(query: DataFrame, candidates: DataFrame, constraints: DataFrame, minimum_types: int = 2) -> DataFrame:
    """Candidates that share at least two constraint types with the query, most shared pairs first."""
    pairs = constraints.where("scope = 'context'").select("ctype", "cvalue", F.col("owner_id").alias("candidate_key")).distinct()
    hits = query.select("query_id", "ctype", "cvalue").distinct().join(pairs, ["ctype", "cvalue"]).groupBy("query_id", "candidate_key").agg(F.count("*").alias("match_count"), F.count_distinct("ctype").alias("type_count"))
    rows = hits.where(F.col("type_count") >= minimum_types).join(candidates.select("candidate_key", "source_file", "page_number"), "candidate_key")
    return ranked(rows, ["query_id"], [F.col("match_count").desc(), F.col("source_file"), F.col("page_number"), F.col("candidate_key")], name="graph_rank")


#: Constraint types that a set of bits can hold; the vocabulary has about thirty.
MOST_TYPES = 62


def qualify_paths(query: DataFrame, candidates: DataFrame, constraints: DataFrame, minimum_types: int = 2, allow_condition_class: bool = False) -> DataFrame:
    """Every (query, candidate) that shares a constraint or conflicts in condition, with the first reason that fails it.

    Order of reasons: condition_conflict, insufficient_types, missing_strong_anchor, missing_specific_anchor,
    no_content_supported_match, broad_content_only, condition_class_only, qualified.
    """
    q = query.select("query_id", "ctype", "cvalue", "strong").distinct()
    is_type = lambda t: F.col("ctype") == t
    broad = F.lit(False)
    for t, v in BROAD_CONTENT:
        broad = broad | ((F.col("ctype") == t) & (F.col("cvalue") == v))
    # a candidate's constraints travel as one row with its page, so that what it names needs no joins of its own
    scopes = F.collect_set(F.struct("ctype", "cvalue", "scope"))
    owned = constraints.where(F.col("scope").isin("context", "content", "source")).groupBy(F.col("owner_id").alias("candidate_key")).agg(scopes.alias("all"))
    owned = owned.join(candidates.select("candidate_key", "source_file", "page_number"), "candidate_key")
    within = lambda scope, x: F.exists("all", lambda y: (y["scope"] == scope) & (y["ctype"] == x["ctype"]) & (y["cvalue"] == x["cvalue"]))
    condition = lambda scope: F.exists("all", lambda y: (y["scope"] == scope) & (y["ctype"] == "clinical_condition"))
    items = F.transform(F.filter("all", lambda x: x["scope"] == "context"), lambda x: F.struct(x["ctype"].alias("ctype"), x["cvalue"].alias("cvalue"), within("content", x).alias("content"), within("source", x).alias("source")))
    rows = owned.select("candidate_key", "source_file", "page_number", condition("context").alias("candidate_condition"), condition("source").alias("source_condition"), F.explode(items).alias("x")).select("*", "x.*").drop("x")
    # types as bits: sums of fixed width stay in the hash aggregate, where sets and texts would fall out of it
    types = q.select(F.col("ctype").alias("_type")).distinct().agg(F.sort_array(F.collect_list("_type")).alias("_types"))
    types = types.withColumn("_types", F.when(F.size("_types") > MOST_TYPES, F.raise_error(F.lit("too many constraint types")).cast("array<string>")).otherwise(F.col("_types")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position("_types", F.col("ctype")) - 1).cast("int"))
    asked = q.join(q.groupBy("query_id").agg(F.bool_or(is_type("clinical_condition")).alias("query_condition")), "query_id").crossJoin(F.broadcast(types)).withColumn("bit", bit).drop("_types")
    matched = rows.join(asked, ["ctype", "cvalue"])
    specific = F.col("ctype").isin(*SPECIFIC_ANCHORS) | (is_type("medication_class") & ~broad)
    content = F.col("content")
    held = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("bit"))), F.lit(0).cast("long"))
    any_of = lambda c: F.max(c.cast("int")) == 1
    rows = matched.groupBy("query_id", "candidate_key", "source_file", "page_number", "candidate_condition", "source_condition", "query_condition").agg(
        F.count("*").alias("match_count"),
        F.bit_or("bit").alias("bits"),
        F.count_if(content).alias("content_match_count"),
        F.bit_count(held(content)).cast("long").alias("content_type_count"),
        any_of(F.col("strong") | F.col("ctype").isin(*STRONG_ANCHORS)).alias("strong"),
        any_of(specific).alias("specific"),
        any_of(content & ~broad).alias("content_specific"),
        any_of(is_type("clinical_condition")).alias("has_condition"),
        any_of(is_type("medication_class")).alias("has_class"),
        any_of(is_type("medication_class") & ~broad).alias("has_own_class"),
        any_of(is_type("clinical_condition") & F.col("source")).alias("condition_in_source"),
        any_of(is_type("clinical_condition") & content).alias("condition_in_content"),
    )
    rows = rows.withColumn("type_count", F.bit_count("bits").cast("long")).crossJoin(F.broadcast(types))
    rows = rows.withColumn("signature", F.array_join(F.filter("_types", lambda t, i: F.getbit("bits", i) == 1), "+")).drop("bits", "_types")
    only_class = F.col("has_condition") & F.col("has_class") & (F.col("type_count") == 2)
    reason = (
        F.when(F.col("query_condition") & F.col("candidate_condition") & ~F.col("has_condition"), "condition_conflict")
        .when(F.col("type_count") < minimum_types, "insufficient_types")
        .when(~F.col("strong"), "missing_strong_anchor")
        .when(~F.col("specific"), "missing_specific_anchor")
        .when(F.col("content_match_count") == 0, "no_content_supported_match")
        .when(~F.col("content_specific"), "broad_content_only")
        .when(only_class & (~F.lit(allow_condition_class) | ~F.col("has_own_class")), "condition_class_only")
        .otherwise("qualified")
    )
    tier = (
        F.when(~F.col("query_condition"), 3)
        .when(F.col("condition_in_source"), 0)
        .when(F.col("condition_in_content") & ~F.col("source_condition"), 1)
        .when(F.col("condition_in_content"), 2)
        .otherwise(4)
    )
    return rows.withColumn("reason", reason).withColumn("tier", tier).select("query_id", "candidate_key", "source_file", "page_number", "reason", "tier", "match_count", "type_count", "content_match_count", "content_type_count", "signature", "candidate_condition")


PATH_ORDER = ("tier", "-content_type_count", "-content_match_count", "-type_count", "-match_count", "source_file", "page_number", "candidate_key")


def _order(names: Sequence[str]) -> list[Column]:
    return [F.col(n[1:]).desc() if n[0] == "-" else F.col(n) for n in names]


def select_with_quotas(qualified: DataFrame, total: int = 20, per_source: int = 2, per_page: int = 1, order: Sequence[str] = PATH_ORDER) -> DataFrame:
    """Rows that greedy taking selects while page, source and total have room, with route_rank.

    Each counter only grows, so a row that one quota drops implies that every later row of its group is dropped too:
    three chained limits on groups, each planned before its sort, and small after the first.
    """
    o = _order(order)
    of_page = ranked(qualified, ["query_id", "source_file", "page_number"], o, per_page, "nth").drop("nth")
    of_source = ranked(of_page, ["query_id", "source_file"], o, per_source, "nth").drop("nth")
    return ranked(of_source, ["query_id"], o, total, "route_rank")


def route_with_quotas(qualified: DataFrame, total: int = 20, per_source: int = 2, per_page: int = 1, order: Sequence[str] = PATH_ORDER) -> DataFrame:
    """Quota routing of every row: raw_rank, route_decision (selected or the quota that dropped the row), route_rank.

    A row is dropped by the first of page, source and total that is full before it. Where a page or source becomes
    full is the place of its last selected row, so only those few places are joined to all rows.
    """
    place = F.struct(*[(-F.col(n[1:]) if n[0] == "-" else F.col(n)).alias(f"o{i}") for i, n in enumerate(order)])
    rows = qualified.withColumn("place", place)
    chosen = select_with_quotas(rows, total, per_source, per_page, order)
    full = lambda keys, n, name: chosen.groupBy("query_id", *keys).agg(F.count("*").alias("n"), F.max("place").alias(name)).where(F.col("n") >= n).drop("n")
    pages, sources = full(("source_file", "page_number"), per_page, "page_full"), full(("source_file",), per_source, "source_full")
    picks = chosen.select("query_id", "candidate_key", F.col("route_rank").cast("long").alias("route_rank"))
    df = rows
    for keys, right in ((("query_id", "source_file", "page_number"), pages), (("query_id", "source_file"), sources), (("query_id", "candidate_key"), picks)):
        right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
        df = df.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    past = lambda c: F.coalesce(F.col("place") > F.col(c), F.lit(False))
    decision = F.when(F.col("route_rank").isNotNull(), "selected").when(past("page_full"), "source_page_quota").when(past("source_full"), "source_quota").otherwise("total_quota")
    df = df.withColumn("route_decision", decision).withColumn("raw_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return df.drop("place", "page_full", "source_full")


def grow_pool(prefix: DataFrame, source: DataFrame, prefix_budget: int, budget: int) -> DataFrame:
    """The first ``prefix_budget`` of one ranking, then what the other adds in its order, ``budget`` rows in all.

    Both are (query_id, candidate_key, rank); a key counts where it stands first.
    """
    both = prefix.where(F.col("rank") <= prefix_budget).select("query_id", "candidate_key", F.lit(0).alias("part"), "rank").unionByName(source.select("query_id", "candidate_key", F.lit(1).alias("part"), "rank"))
    first = both.groupBy("query_id", "candidate_key").agg(F.min(F.struct("part", "rank")).alias("at"))
    return ranked(first, ["query_id"], [F.col("at"), F.col("candidate_key")], budget, "pool_rank").drop("at")


def late_union(before: DataFrame, after: DataFrame, budget: int) -> DataFrame:
    """One pool of the candidates of two, those of both as the first has them, by cached scores; the first ``budget``.

    Rows are (query_id, candidate_key, reranker_score, rrf_score). A diagnosis of late pruning, not a method.
    """
    extra = after.join(before.select("query_id", "candidate_key"), ["query_id", "candidate_key"], "left_anti")
    names = ["query_id", "candidate_key", "reranker_score", "rrf_score"]
    pool = before.select(*names).unionByName(extra.select(*names)).na.fill(0.0, names[2:])
    order = [F.col("reranker_score").desc(), F.col("rrf_score").desc(), F.col("candidate_key")]
    return ranked(pool, ["query_id"], order, budget, "post_rerank_rank")


def pool_differences(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per query, identities (all of ``fields``) that either pool holds twice or only one of them holds.

    No rows means that the second is a pure reordering of the first.
    """
    count = lambda df, c: df.groupBy("query_id", *fields).agg(F.count("*").alias(c))
    l, r = count(before, "b"), count(after, "a").withColumnsRenamed({f: f"_{f}" for f in ("query_id", *fields)})
    both = l.join(r, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in ("query_id", *fields)], "full_outer")
    g = both.groupBy(F.coalesce("query_id", "_query_id").alias("query_id")).agg(F.count_if((F.coalesce("b", F.lit(0)) > 1) | (F.coalesce("a", F.lit(0)) > 1)).alias("repeated"), F.count_if(F.col("a").isNull()).alias("only_before"), F.count_if(F.col("b").isNull()).alias("only_after"))
    return g.where("repeated + only_before + only_after > 0")


def trace_failures(traces: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored traces that a rebuild from the index does not confirm, with the first reason.

    ``traces(query_id, candidate_key, source_file, page_number, tier, signature, route_rank)`` against the rows of
    ``qualify_paths``. A path must still be there, qualify, and agree in identity, constraint types and tier.
    """
    names = ("source_file", "page_number", "tier", "signature", "reason")
    own = paths.select("query_id", "candidate_key", *[F.col(c).alias(f"_{c}") for c in names])
    df = traces.join(own, ["query_id", "candidate_key"], "left")
    differs = lambda *cs: ~F.array_min(F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cs]))
    reason = (
        F.when(F.col("_reason").isNull(), "not_in_index")
        .when(differs("source_file", "page_number"), "identity")
        .when(F.col("_reason") != "qualified", "no_longer_qualified")
        .when(differs("signature"), "constraint_types")
        .when(differs("tier"), "source_tier")
        .when(~F.coalesce(F.col("route_rank") >= 1, F.lit(False)), "route_rank")
    )
    return df.select("query_id", "candidate_key", reason.alias("failure")).where("failure IS NOT NULL")


def coverage_audit(questions: DataFrame, query: DataFrame, candidates: DataFrame, constraints: DataFrame, paths: DataFrame, minimum_types: int = 2, top: int = 5) -> DataFrame:
    """A10: per question, how many candidates have a path to it, by which constraint types, and why the others have none.

    ``paths`` are the rows of ``qualify_paths`` without a limit. Candidates that share nothing with a question are
    counted, not joined: they fail for a condition that both name, or for too few types.
    """
    context = constraints.where("scope = 'context'")
    totals = candidates.agg(F.count("*").alias("all_candidates")).crossJoin(context.where("ctype = 'clinical_condition'").agg(F.count_distinct("owner_id").alias("all_named")))
    posted = query.join(context.select("ctype", "cvalue").distinct(), ["ctype", "cvalue"]).groupBy("query_id").agg(F.count_distinct("ctype").alias("posted_types"))
    asked = query.groupBy("query_id").agg(F.count_distinct("ctype", "cvalue").alias("constraint_count"), F.count_distinct("ctype").alias("constraint_type_count"), F.bool_or(F.col("ctype") == "clinical_condition").alias("asks_condition"))
    good = F.col("reason") == "qualified"
    met = paths.groupBy("query_id").agg(F.count("*").alias("met"), F.count_if("candidate_condition").alias("met_named"), F.max("type_count").alias("most_types"), F.count_if(good).alias("potential_path_count"), F.count_distinct(F.when(good, F.col("source_file"))).alias("candidate_source_count"))
    df = questions.select("query_id").crossJoin(F.broadcast(totals))
    for part in (asked, posted, met):
        df = df.join(part, "query_id", "left")
    df = df.na.fill(0).na.fill(False)
    conflict = F.when(F.col("asks_condition"), F.col("all_named") - F.col("met_named")).otherwise(0)
    unmet = df.select("query_id", F.explode(F.array(F.struct(F.lit("condition_conflict").alias("reason"), conflict.alias("n")), F.struct(F.lit("insufficient_types").alias("reason"), (F.col("all_candidates") - F.col("met") - conflict).alias("n")))).alias("x")).select("query_id", "x.*")
    failures = paths.where(~good).groupBy("query_id", "reason").agg(F.count("*").alias("n")).unionByName(unmet).groupBy("query_id", "reason").agg(F.sum("n").alias("n")).where("n > 0")
    listed = lambda c, of: F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(of)), 1, c) if c else F.sort_array(F.collect_list(of)), lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",")
    tops = failures.groupBy("query_id").agg(listed(top, F.struct((-F.col("n")).alias("o"), F.col("reason").alias("name"), "n")).alias("top_failures"), F.bool_or(F.col("reason") == "no_content_supported_match").alias("no_content"), F.bool_or(F.col("reason") == "broad_content_only").alias("broad"))
    signatures = paths.where(good).groupBy("query_id", "signature").agg(F.count("*").alias("n")).groupBy("query_id").agg(listed(None, F.struct(F.col("signature").alias("name"), "n")).alias("signatures"))
    df = df.join(tops, "query_id", "left").join(signatures, "query_id", "left").na.fill(False).na.fill("", ["top_failures", "signatures"])
    reason = (
        F.when(F.col("constraint_count") == 0, "zero_query_constraints")
        .when(F.col("constraint_type_count") < minimum_types, "insufficient_query_types")
        .when(F.col("potential_path_count") > 0, "not_applicable")
        .when(F.col("no_content"), "no_content_supported_match")
        .when(F.col("broad"), "broad_content_only")
        .otherwise("no_posting")
    )
    few = F.when(F.col("posted_types") < minimum_types, "insufficient_posting_types").when(F.col("most_types") < minimum_types, "no_candidate_cooccurrence").otherwise("path_policy_filtered")
    diagnosis = F.when(reason == "no_posting", few).when(reason.isin("no_content_supported_match", "broad_content_only"), "path_policy_filtered").otherwise(reason)
    return df.select("query_id", "constraint_count", "constraint_type_count", "potential_path_count", "candidate_source_count", "most_types", "signatures", "top_failures", reason.alias("zero_path_reason"), diagnosis.alias("zero_path_diagnosis"))


def expand_with_budget(baseline: DataFrame, graph: DataFrame, budget: int, quota: int) -> DataFrame:
    """baseline[:budget-g] then g graph candidates that the baseline lacks, g = min(quota, budget, those there are).

    ``baseline(query_id, candidate_key, rank)``, ``graph(query_id, candidate_key, graph_rank)``.
    """
    base = ranked(ranked(baseline.select("query_id", "candidate_key", "rank"), ["query_id", "candidate_key"], [F.col("rank")], 1, "nth").drop("nth"), ["query_id"], [F.col("rank")], name="place").select("query_id", "candidate_key", "place")
    fresh = ranked(graph.select("query_id", "candidate_key", "graph_rank").join(base, ["query_id", "candidate_key"], "left_anti"), ["query_id"], [F.col("graph_rank"), F.col("candidate_key")], min(quota, budget), "g_place")
    taken = fresh.groupBy("query_id").agg(F.count("*").alias("g"))
    left = base.join(taken, "query_id", "left").where(F.col("place") <= budget - F.coalesce("g", F.lit(0))).select("query_id", "candidate_key", F.lit("baseline").alias("origin"), F.col("place").alias("o"))
    right = fresh.select("query_id", "candidate_key", F.lit("graph").alias("origin"), (F.col("g_place") + budget).alias("o"))
    return ranked(left.unionByName(right), ["query_id"], [F.col("o")], name="expanded_rank").drop("o")


#: Weights of the source-condition tiers, by tier number.
TIER_WEIGHTS = {0: 1.0, 1: 0.75, 2: 0.5, 3: 0.25, 4: 0.0}


def path_score(tier: Column, matched_types: Column, content_types: Column, query_types: Column, route_rank: Column, weights: dict[int, float] = TIER_WEIGHTS) -> Column:
    """Mean of tier weight, matched and content type coverage, and reciprocal route rank, to twelve digits."""
    clip = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 12)
    w = F.lit(None).cast("double")
    for t, value in weights.items():
        w = F.when(tier == t, F.lit(value)).otherwise(w)
    return F.round((clip(w) + clip(matched_types / query_types) + clip(content_types / query_types) + clip(F.lit(1.0) / route_rank)) / 4, 12)


def shift_ranks(pool: DataFrame, max_shift: float = 2.0) -> DataFrame:
    """New order by rank minus shift times path score (0 without a path), then old rank and key; no shift changes nothing."""
    moved = pool.withColumn("adjusted_rank", F.col("rank") - F.lit(max_shift) * F.coalesce("path_score", F.lit(0.0)))
    return ranked(moved, ["query_id"], [F.col("adjusted_rank"), F.col("rank"), F.col("candidate_key")], name="new_rank")


def coverage_rerank(pool: DataFrame, query: DataFrame, constraints: DataFrame, type_weights: dict[str, float], top_k: int | None = None, weights: tuple[float, float, float] = (0.65, 0.20, 0.15)) -> DataFrame:
    """Rerank by relevance, authority and weighted coverage of the query's constraint types.

    Applied only where the query has constraints and some candidate covers one; otherwise the order stays and
    ``rerank_status`` says why.
    """
    weight = F.lit(1.0)
    for t, w in type_weights.items():
        weight = F.when(F.col("ctype") == t, F.lit(float(w))).otherwise(weight)
    asked = query.select("query_id", "ctype").distinct().withColumn("w", weight)
    total = asked.groupBy("query_id").agg(F.sum("w").alias("asked_weight"))
    held = constraints.where("scope = 'content'").select(F.col("owner_id").alias("candidate_key"), "ctype").distinct()
    covered = pool.select("query_id", "candidate_key").join(asked, "query_id").join(held, ["candidate_key", "ctype"]).groupBy("query_id", "candidate_key").agg(F.sum("w").alias("covered_weight"))
    df = pool.join(total, "query_id", "left").join(covered, ["query_id", "candidate_key"], "left")
    coverage = F.when(F.coalesce("asked_weight", F.lit(0.0)) > 0, F.coalesce("covered_weight", F.lit(0.0)) / F.col("asked_weight")).otherwise(0.0)
    df = df.withColumn("coverage", coverage)
    most = F.max("coverage").over(Window.partitionBy("query_id"))
    status = F.when(F.col("asked_weight").isNull(), "no_query_constraints").when(most <= 0, "no_coverage").otherwise("applied")
    a, b, c = weights
    df = df.withColumn("rerank_status", status).withColumn("graph_score", F.round(F.lit(a) * F.col("relevance_score") + F.lit(b) * F.col("authority_weight") + F.lit(c) * F.col("coverage"), 10))
    key = F.when(F.col("rerank_status") == "applied", -F.col("graph_score")).otherwise(F.lit(0.0))
    return ranked(df.drop("asked_weight", "covered_weight"), ["query_id"], [key, F.col("rank"), F.col("candidate_key")], top_k, "new_rank")


def audit_constraints(query: DataFrame, evidence: DataFrame, exclusive: Sequence[str] = EXCLUSIVE_IN_RERANK) -> DataFrame:
    """Each query constraint against all evidence values of its type: matched beats conflict beats unsupported."""
    q = query.select("query_id", "ctype", "cvalue").distinct()
    e = evidence.select("query_id", "ctype", F.col("cvalue").alias("evidence_value")).distinct()
    t, a, b = F.col("ctype"), F.col("cvalue"), F.col("evidence_value")
    state = F.when(values_match(t, a, b), 2).when(values_conflict(t, a, b, exclusive), 1).otherwise(0)
    best = q.join(e, ["query_id", "ctype"], "left").groupBy("query_id", "ctype", "cvalue").agg(F.coalesce(F.max(state), F.lit(0)).alias("s"))
    return best.select("query_id", "ctype", "cvalue", F.when(F.col("s") == 2, "matched").when(F.col("s") == 1, "conflict").otherwise("unsupported").alias("status"))


def constraint_graph(query: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the runtime graph: what a query requires, and what evidence matches or contradicts."""
    node = lambda df, kind, *parts: df.select("query_id", F.concat_ws(":", F.lit(kind), *parts).alias("node_id"), F.lit(kind).alias("node_type"))
    nodes = node(query, "query", "query_id").unionByName(node(query, "constraint", "ctype", "cvalue")).unionByName(node(evidence, "evidence", "candidate_key")).distinct()
    wants = query.select("query_id", F.concat_ws(":", F.lit("query"), "query_id").alias("source"), F.concat_ws(":", F.lit("constraint"), "ctype", "cvalue").alias("target"), F.lit("REQUIRES").alias("edge_type"))
    pairs = query.select("query_id", "ctype", "cvalue").join(evidence.select("query_id", "candidate_key", "ctype", F.col("cvalue").alias("evidence_value")), ["query_id", "ctype"])
    t, a, b = F.col("ctype"), F.col("cvalue"), F.col("evidence_value")
    kinds = F.array_compact(F.array(F.lit("MATCHES_TYPE"), F.when(values_match(t, a, b), "MATCHES_VALUE"), F.when(values_conflict(t, a, b), "CONFLICTS")))
    found = pairs.select("query_id", F.concat_ws(":", F.lit("evidence"), "candidate_key").alias("source"), F.concat_ws(":", F.lit("constraint"), "ctype", "cvalue").alias("target"), F.explode(kinds).alias("edge_type"))
    return nodes, wants.unionByName(found).distinct()


def graph_violations(nodes: DataFrame, edges: DataFrame, root_type: str = "query", edge_types: Sequence[str] = ("REQUIRES", "MATCHES_TYPE", "MATCHES_VALUE", "CONFLICTS")) -> DataFrame:
    """Breaks of the graph contract as (query_id, violation, subject).

    Node and edge identities are unique, edge types known, both ends exist, there is one root, and every other node
    hangs on an edge.
    """
    said = lambda df, name, what: df.select("query_id", F.lit(name).alias("violation"), what.cast("string").alias("subject"))
    edge = ("query_id", "source", "target", "edge_type")
    ends = edges.select("query_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    parts = [
        said(nodes.groupBy("query_id", "node_id").count().where("count > 1"), "duplicate_node", F.col("node_id")),
        said(edges.groupBy(*edge).count().where("count > 1"), "duplicate_edge", F.concat_ws("|", *edge[1:])),
        said(edges.where(~F.col("edge_type").isin(*edge_types)), "unknown_edge_type", F.col("edge_type")),
        said(ends.join(nodes.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"), "missing_endpoint", F.col("node_id")),
        said(nodes.where(F.col("node_type") != root_type).join(ends, ["query_id", "node_id"], "left_anti"), "loose_node", F.col("node_id")),
        said(nodes.groupBy("query_id").agg(F.count_if(F.col("node_type") == root_type).alias("n")).where("n <> 1"), "root_count", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def compare_query_to_evidence(query: DataFrame, evidence: DataFrame, exclusive: Sequence[str], high_risk: Sequence[str], context_types: Sequence[str]) -> DataFrame:
    """Per query and type: match on content, corrective mismatch, coverage gap, scope mismatch on context.

    A mismatch needs an exclusive type with exactly one evidence value that the query lacks.
    """
    q = query.groupBy("query_id", "ctype").agg(F.collect_set("cvalue").alias("asked"))
    side = lambda scope, name: evidence.where(F.col("scope") == scope).groupBy("query_id", "ctype").agg(F.collect_set("cvalue").alias(name))
    df = q.join(side("content", "content"), ["query_id", "ctype"], "left").join(side("context", "context"), ["query_id", "ctype"], "left")
    content, context = (F.coalesce(c, F.array().cast("array<string>")) for c in ("content", "context"))
    apart = lambda x: ~F.arrays_overlap("asked", x)
    return df.select(
        "query_id",
        "ctype",
        F.arrays_overlap("asked", content).alias("supported_match"),
        (F.col("ctype").isin(*exclusive) & (F.size(content) == 1) & apart(content)).alias("corrective_value_mismatch"),
        (F.col("ctype").isin(*high_risk) & (F.size(content) == 0)).alias("coverage_gap"),
        (F.col("ctype").isin(*context_types) & (F.size(context) > 0) & apart(context)).alias("scope_mismatch"),
    )


def compare_evidence_pairs(evidence: DataFrame, ranks: DataFrame, exclusive: Sequence[str], anchors: Sequence[str], context_types: Sequence[str], need_scope: bool = True) -> DataFrame:
    """Pairs of a query's evidence: comparable with a shared anchor and no disjoint scope; conflicts on exclusive types.

    ``ranks`` is a short list per query (top 4), so pairs of it are few.
    """
    left, right = ranks.select("query_id", F.col("candidate_key").alias("a"), F.col("rank").alias("i")), ranks.select("query_id", F.col("candidate_key").alias("b"), F.col("rank").alias("j"))
    pairs = left.join(right, "query_id").where("i < j")
    sets = evidence.where(F.col("scope").isin("content", "context")).groupBy("query_id", "candidate_key", "scope", "ctype").agg(F.collect_set("cvalue").alias("vals"))
    l, r = sets.select("query_id", F.col("candidate_key").alias("a"), "scope", "ctype", F.col("vals").alias("lv")), sets.select("query_id", F.col("candidate_key").alias("b"), "scope", "ctype", F.col("vals").alias("rv"))
    both = pairs.join(l, ["query_id", "a"]).join(r, ["query_id", "b", "scope", "ctype"])
    hit = F.arrays_overlap("lv", "rv")
    of = lambda scope, kinds: (F.col("scope") == scope) & F.col("ctype").isin(*kinds)
    flags = both.groupBy("query_id", "a", "b").agg(
        F.bool_or(of("context", anchors) & hit).alias("anchor"),
        F.bool_or(of("context", context_types) & hit).alias("scope_shared"),
        F.bool_or(of("context", context_types) & ~hit).alias("scope_apart"),
        F.bool_or(of("content", exclusive) & ~hit).alias("differs"),
    )
    df = pairs.join(flags, ["query_id", "a", "b"], "left").na.fill(False, ["anchor", "scope_shared", "scope_apart", "differs"])
    comparable = F.col("anchor") & ~F.col("scope_apart") & (F.col("scope_shared") | F.lit(not need_scope))
    return df.select("query_id", F.col("a").alias("left_key"), F.col("b").alias("right_key"), comparable.alias("comparable"), F.when(~comparable, "not_comparable").when(F.col("differs"), "evidence_evidence_conflict").otherwise("").alias("label"))


def route_action(boundary: Column, conflict: Column, scope: Column, gap: Column, corrective: Column, supported: Column) -> Column:
    """Action by precedence: boundary, review, insufficient, corrective, supported, nothing comparable."""
    return (
        F.when(boundary, "boundary_refusal_passthrough")
        .when(conflict | scope, "review_required")
        .when(gap, "insufficient_evidence")
        .when(corrective, "allow_corrective_answer")
        .when(supported, "allow_supported_answer")
        .otherwise("insufficient_evidence")
    )


#: Worst state first.
CLAIM_STATES = ("contradicted", "unsupported", "insufficient_evidence", "supported")


def align_claims(claims: DataFrame, evidence: DataFrame, exclusive: Sequence[str] = EXCLUSIVE_IN_CLAIMS) -> DataFrame:
    """State of each claim ``(answer_id, claim_id, ctype, cvalue, stance)`` against ``evidence(answer_id, ctype, cvalue)``.

    A constraint without evidence of its type is unsupported; an asserted conflict or a rejected match contradicts;
    a claim without constraints is insufficient. A claim has the worst state of its constraints.
    """
    e = evidence.select("answer_id", "ctype", F.col("cvalue").alias("evidence_value")).distinct()
    t, a, b = F.col("ctype"), F.col("cvalue"), F.col("evidence_value")
    m, c = values_match(t, a, b), values_conflict(t, a, b, exclusive)
    per = claims.join(e, ["answer_id", "ctype"], "left").groupBy("answer_id", "claim_id", "ctype", "cvalue", "stance").agg(F.coalesce(F.bool_or(m), F.lit(False)).alias("m"), F.coalesce(F.bool_or(c), F.lit(False)).alias("c"))
    asserted = F.col("stance") == "assert"
    state = (
        F.when(F.col("ctype").isNull(), 2)
        .when(F.col("m"), F.when(asserted, 3).otherwise(0))
        .when(F.col("c"), F.when(asserted, 0).otherwise(3))
        .otherwise(1)
    )
    worst = per.groupBy("answer_id", "claim_id").agg(F.min(state).alias("s"))
    names = F.array(*[F.lit(s) for s in CLAIM_STATES])
    return worst.select("answer_id", "claim_id", F.element_at(names, F.col("s") + 1).alias("claim_state"))


def overall_state(claims: DataFrame) -> DataFrame:
    """Per answer: the worst claim state, counts of all states, coverage ratio, and whether it needs review."""
    order = F.array_position(F.array(*[F.lit(s) for s in CLAIM_STATES]), F.col("claim_state"))
    agg = claims.groupBy("answer_id").agg(F.min(order).cast("int").alias("w"), F.count("*").alias("claims"), *[F.count_if(F.col("claim_state") == s).alias(s) for s in CLAIM_STATES])
    state = F.element_at(F.array(*[F.lit(s) for s in CLAIM_STATES]), F.col("w"))
    return agg.withColumn("overall_state", state).withColumn("coverage_ratio", F.round(F.col("supported") / F.col("claims"), 6)).withColumn("requires_review", F.col("overall_state").isin("contradicted", "unsupported")).drop("w")
