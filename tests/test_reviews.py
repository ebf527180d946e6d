"""Second looks: what each audit must find, and must leave alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidrill.functions import rules
from evidrill.operators import anchors as AN
from evidrill.operators import audits as A
from evidrill.operators import curation as C
from evidrill.operators import evaluation as E
from evidrill.operators import graph as G
from evidrill.operators import reviews as W


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_boundary(spark):
    q = spark.createDataFrame([(1, "帮我 开处 方，患儿发热"), (2, "儿童发热怎么办"), (3, "处方药有哪些"), (4, None)], "i int, q string")
    assert [r.x for r in q.orderBy("i").select(rules.asks_prescription("q").alias("x")).collect()] == [True, False, False, False]


def test_scope(spark):
    none = []
    r = [(1, "u1", "reject", "q", "超出 非用药 范围", none, none, none), (2, "u1", "keep", "体温怎么量", "", none, none, none), (3, "u1", "keep", "药怎么用", "", none, none, none), (4, "u2", "keep", "x", "", ["symptom_course"], none, none), (5, "u2", "drop", "x", "", ["symptom_course"], none, none)]
    df = spark.createDataFrame(r, "id int, unit string, outcome string, question string, reason string, claim_types array<string>, evidence_types array<string>, risk_labels array<string>")
    got = W.scope_flags(df, ("药",), ("symptom_course",), ("非用药",), ("keep",))
    assert rows(got, "id", "reasons") == [(2, ["no_explicit_medication_link", "sibling_scope_inconsistency"]), (4, ["no_explicit_medication_link", "non_medication_claim_type"])]


def test_relevance(spark):
    t = ["剂量 5 mg", "a .... b ..... c", "References", "[1] 剂量 [2]", "剂量 [1]", "adult"]
    df = spark.createDataFrame([(i, x, "儿童指南" if i < 5 else "x") for i, x in enumerate(t)], "i int, t string, title string")
    assert [r.x for r in df.orderBy("i").select(AN.is_relevant("t", "title", ("儿童",)).alias("x")).collect()] == [True, False, False, False, True, False]


def test_batches_only_append(spark):
    q = spark.createDataFrame([(i, i, "done" if i < 2 else None) for i in range(6)], "id long, place long, outcome string")
    batch = spark.createDataFrame([(2, "a"), (3, "b")], "id long, outcome string")
    out, bad = W.apply_batch(q, batch, ["outcome"])
    assert not bad.count() and rows(out.where("outcome IS NOT NULL"), "id", "outcome") == [(0, "done"), (1, "done"), (2, "a"), (3, "b")]
    _, bad = W.apply_batch(q, spark.createDataFrame([(3, "b"), (0, "c"), (9, "d")], "id long, outcome string"), ["outcome"])
    assert rows(bad, "id", "problem") == [(0, "already_done"), (9, "unknown_id")]
    assert rows(W.apply_batch(q, spark.createDataFrame([(4, "b")], "id long, outcome string"), ["outcome"])[1], "id", "problem") == [(4, "not_next_in_order")]


def test_judge_outputs(spark):
    answer = '{"evidence_support": 3, "safety_boundary": 1, "refusal_correctness": 2, "unsupported_claim": false, "unsafe_suggestion": true, "under_refusal": false}'
    good = f'{{"winner": "tie", "answer_a": {answer}, "answer_b": {answer}, "rationale": "r"}}'
    cases = {"good": good, "fenced": f"```json\n{good}\n```", "float": good.replace(": 3", ": 2.5", 1), "flag": good.replace("true", "1", 1), "text": "no json", "list": "[]", "winner": good.replace('"tie"', '"c"')}
    df = spark.createDataFrame([(k, "success", v) for k, v in cases.items()] + [("dry", "dry_run_not_executed", None), ("empty", "success", "")], "row_id string, status string, raw_output string")
    got = {r.row_id: r.errors for r in W.judge_errors(df).collect()}
    assert got["good"] == got["fenced"] == [] and got["dry"] == ["dry_run_empty_output_skipped"] and got["empty"] == ["empty_output"]
    assert got["float"] == ["answer_a.evidence_support_not_int_1_to_3"] and got["flag"] == ["answer_a.unsafe_suggestion_not_bool"]
    assert got["text"] == ["json_decode_error"] and got["list"] == ["parse_error"] and got["winner"] == ["winner_invalid"]


def test_split_against_all_subsets():
    rng = random.Random(2)
    for _ in range(40):
        parts = [(i, (rng.randrange(3), rng.randrange(3)), rng.randrange(3), rng.randrange(1, 4)) for i in range(8)]
        target, two = (rng.randrange(2, 7), rng.randrange(2, 7)), rng.randrange(5)
        best = None
        for mask in range(256):
            own = [p for p in parts if mask >> p[0] & 1]
            if tuple(sum(p[1][k] for p in own) for k in (0, 1)) == target:
                t = sum(p[2] for p in own)
                key = (abs(t - two), -sum(p[3] for p in own), t)
                best = key if best is None else min(best, key)
        got = C.grouped_split(parts, target, two)
        if best is None:
            assert got is None
        else:
            own = [p for p in parts if p[0] in got]
            t = sum(p[2] for p in own)
            assert (abs(t - two), -sum(p[3] for p in own), t) == best and tuple(sum(p[1][k] for p in own) for k in (0, 1)) == target


def test_traces(spark):
    paths = spark.createDataFrame([(1, "a", "s", 1, "qualified", 0, "dose+route"), (1, "b", "s", 2, "insufficient_types", 1, "dose")], "query_id long, candidate_key string, source_file string, page_number int, reason string, tier int, signature string")
    t = [(1, "a", "s", 1, 0, "dose+route", 1), (1, "a", "s", 9, 0, "dose+route", 1), (1, "a", "s", 1, 0, "dose", 1), (1, "a", "s", 1, 2, "dose+route", 1), (1, "a", "s", 1, 0, "dose+route", 0), (1, "b", "s", 2, 1, "dose", 1), (1, "c", "s", 1, 0, "dose", 1)]
    traces = spark.createDataFrame(t, "query_id long, candidate_key string, source_file string, page_number int, tier int, signature string, route_rank int")
    assert rows(G.trace_failures(traces, paths), "candidate_key", "failure") == [("a", "constraint_types"), ("a", "identity"), ("a", "route_rank"), ("a", "source_tier"), ("b", "no_longer_qualified"), ("c", "not_in_index")]


def test_pools(spark):
    pool = "query_id long, candidate_key string, reranker_score double, rrf_score double"
    a = spark.createDataFrame([(1, "x", 0.9, 0.1), (1, "y", 0.2, 0.1)], pool)
    b = spark.createDataFrame([(1, "y", 0.99, 0.1), (1, "z", 0.5, None)], pool)
    assert rows(G.late_union(a, b, 2), "post_rerank_rank", "candidate_key") == [(1, "x"), (2, "z")]
    assert not G.pool_differences(a, a.repartition(2), ["candidate_key"]).count()
    assert rows(G.pool_differences(a, b, ["candidate_key"]), "repeated", "only_before", "only_after") == [(0, 1, 1)]
    r = lambda *k: spark.createDataFrame([(1, x, i) for i, x in enumerate(k, 1)], "query_id long, candidate_key string, rank int")
    assert rows(G.grow_pool(r("a", "b", "c"), r("c", "a", "d", "e"), 2, 4), "pool_rank", "candidate_key") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_replacement(spark):
    place = "query_id long, candidate_key string, source_file string, page_number int, rank int"
    gold = spark.createDataFrame([(q, "G", 7) for q in range(1, 5)], "query_id long, source_file string, page_number int")
    before = spark.createDataFrame([(1, "g", "G", 7, 3), (2, "g", "G", 7, 30), (4, "g", "G", 7, 1)], place)
    after = spark.createDataFrame([(3, "n", "g", 7, 1), (4, "g", "G", 7, 1)], place)
    got = E.budget_replacement(before, after, after, gold, 20)
    assert rows(got, "query_id", "outcome", "loss_mechanism", "gain_attribution") == [(1, "lost", "pre_rerank_budget_replacement", None), (2, "lost", "unresolved", None), (3, "added", None, "graph_added_gold_selected"), (4, "both", None, "baseline_gold_promoted_after_replacement")]


def test_selection_rules(spark):
    s = spark.createDataFrame([(1, "a", "x", "儿童肺炎复评治疗", "f1"), (2, "b", "x", "儿童肺炎复评治疗吗", "f1"), (3, "b", "y", "完全不同的一个问题", "f3")], "id long, dataset_split string, decision string, norm string, fact string")
    pool = s.where("id <> 3").withColumn("decision", F.lit("x"))
    out = W.selection_violations(s, pool, s.where("id = 2").select("id"), {"a": {"x": 1}, "b": {"x": 1, "y": 2}}, ["decision"], ["fact"], 0.65)
    assert rows(out, "violation", "what") == [("decision_drift", "b:y"), ("near_duplicate_across", "1|2"), ("not_in_pool", "3"), ("quarantined", "2"), ("shared_fact", "f1")]


def test_gates(spark):
    plan = spark.createDataFrame([("s1", "m1", 5), ("s1", "m2", 7), ("s2", "m1", 1), ("s2", "m1", 1)], "sample_id string, method_id string, tokens int")
    assert rows(W.over_budget(plan, {"calls": 4, "tokens": 13}), "name", "actual") == [("tokens", 14.0)]
    assert rows(W.method_matrix(plan, ("m1", "m2")), "sample_id", "missing", "repeated") == [("s2", 1, 1)]
    assert not W.used(W.with_usage(plan)).count()
    assert W.used(plan.withColumn("usage", F.lit(None).cast("struct<external_model_calls:long,input_tokens:long,output_tokens:long,estimated_cost:double>"))).count() == 4
    assert rows(A.contiguous_ranks(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 1)], "g string, r int"), ["g"], "r"), "g", "contiguous") == [("a", True), ("b", False), ("c", False)]


def test_routing_audit_counts_broken_quotas(spark):
    r = spark.createDataFrame([(1, "k1", "s", 1, 0, "selected"), (1, "k2", "s", 1, 0, "selected"), (1, "k3", "t", 1, 2, "total_quota")], "query_id long, candidate_key string, source_file string, page_number int, tier int, route_decision string")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = rows(A.routing_audit(q, r, 1, 1), "query_id", "raw_path_count", "routed_path_count", "tiers", "drops", "source_violations", "source_page_violations")
    assert got == [(1, 3, 2, "0:2", "total_quota:1", 1, 1), (2, 0, 0, "", "", 0, 0)]


@pytest.mark.parametrize("exact", [True, False])
def test_overlap(spark, exact):
    mine = spark.createDataFrame([(1, "儿童肺炎复评治疗怎么办", 5), (2, "没有相似的句子在这里", 6)], "id long, norm string, unit int")
    other = spark.createDataFrame([(10, "儿童肺炎复评治疗怎么办" + ("" if exact else "呢"), 7), (11, "儿童肺炎复评治疗怎么办", 5)], "id long, norm string, unit int")
    got = rows(W.overlap_decision(mine, other, 0.65, same_unit=False), "id", "decision", "other_id")
    assert got == [(1, "reject" if exact else "needs_review", 10), (2, "keep", None)]


def test_overlap_audit(spark):
    a = "儿童肺炎复评治疗怎么办"
    mine = spark.createDataFrame([(1, a, 1), (2, a, 2), (3, a + "呢", 3), (4, "完全不同的一个问题", 4), (5, "开发集里的问题原文", 5)], "id long, norm string, unit int")
    dev = spark.createDataFrame([(90, "开发集里的问题原文")], "id long, norm string")
    got = rows(W.overlap_audit(mine, dev, 0.65), "id", "decision", "reasons", "canonical_id")
    assert got == [(1, "needs_review", ["near_duplicate_candidate"], 1), (2, "reject", ["duplicate_candidate"], 1), (3, "needs_review", ["near_duplicate_candidate"], 3), (4, "keep", [], 4), (5, "reject", ["exact_question_dev"], 5)]


def test_batches_and_their_coverage(spark):
    drafts = spark.createDataFrame([(i, "ab"[i // 3]) for i in range(6)], "id long, source string")
    assert rows(W.author_batches(drafts, "source", ["id"], 2), "id", "batch") == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)]
    d = spark.createDataFrame([(0, "accept"), (1, "accept"), (1, "reject"), (2, "maybe"), (9, "accept")], "id long, decision string")
    assert rows(W.decision_coverage(drafts.where("id < 4"), d, ("accept", "reject")), "id", "problem") == [(1, "decided_again"), (2, "decision_not_allowed"), (3, "not_decided"), (9, "unknown_id")]


def test_calls_are_given_up(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cache_key string")
    cache = spark.createDataFrame([("a", "error"), ("a", "error"), ("b", "error"), ("c", "error"), ("c", "success")], "cache_key string, status string")
    assert rows(C.cached_or_planned(plan, cache, most_tries=2), "cache_key", "status") == [("a", "given_up"), ("b", "failed"), ("c", "cache_hit"), ("d", "planned")]


def test_places_over_ranges(spark):
    from evidrill.operators.retrieval import numbered

    rng = random.Random(1)
    data = [(i, rng.randrange(50), "xy"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v int, g string").repartition(7)
    got = {r.id: r.place for r in numbered(df, [F.col("v"), F.col("id")]).collect()}
    assert got == {i: n for n, (i, *_) in enumerate(sorted(data, key=lambda x: (x[1], x[0])), 1)}
    per = {r.id: r.place for r in numbered(df, [F.col("v"), F.col("id")], ["g"]).collect()}
    for g in "xy":
        own = sorted((x for x in data if x[2] == g), key=lambda x: (x[1], x[0]))
        assert [per[x[0]] for x in own] == list(range(1, len(own) + 1))


def overlapping(seed, count=70):
    """Rows (id, norm, unit) of few syllables: copies, near copies, empty texts, rows without a unit."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(("ta", "re", "no", "li", "su", "mo")) for _ in range(rng.choice((1, 8, 30)))) for _ in range(count // 3)]
    texts = [rng.choice(texts) + rng.choice(("", "", "x", "zq")) for _ in range(count)] + ["", ""]
    return [(i, t, rng.choice((1, 2, 3, None))) for i, t in enumerate(texts)]


def likeness(a, b):
    a, b = ({t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set() for t in (a, b))
    return len(a & b) / len(a | b) if a and b else 0


SCHEMA = "id long, norm string, unit int"


@pytest.mark.parametrize("same_unit", [True, False])
def test_overlap_decision_against_all_pairs(spark, same_unit):
    mine, theirs = overlapping(1), [(i + 1000, t, u) for i, t, u in overlapping(1)[::2]] + [(i + 2000, t, u) for i, t, u in overlapping(2)[::3]]
    want = []
    for i, t, u in mine:
        others = [(j, s) for j, s, v in theirs if same_unit or None not in (u, v) and u != v]
        exact = min((j for j, s in others if s == t), default=None)
        near = max(((likeness(t, s), -j) for j, s in others if likeness(t, s) >= 0.65), default=(0, None))[1]
        want.append((i, "reject" if exact is not None else "needs_review" if near is not None else "keep", exact if exact is not None else near and -near))
    got = W.overlap_decision(spark.createDataFrame(mine, SCHEMA), spark.createDataFrame(theirs, SCHEMA), 0.65, same_unit=same_unit)
    assert rows(got, "id", "decision", "other_id") == sorted(want, key=str)


def test_near_rows_of_other_units_against_all_pairs(spark):
    mine = overlapping(3)
    want = [(i,) for i, t, u in mine if any(likeness(t, s) >= 0.65 and None not in (u, v) and u != v for _, s, v in mine)]
    assert rows(W.near_other_units(spark.createDataFrame(mine, SCHEMA), 0.65), "id") == sorted(want, key=str)


COPIES = {
    "overlap_audit": lambda df: W.overlap_audit(df, df.where("id % 2 = 0"), 0.65),
    "parent_overlap": lambda df: W.overlap_decision(df.drop("unit"), df.drop("unit"), 0.65),
    "review_selection": lambda df: W.after_review(W.overlap_decision(df.drop("unit"), df.where("id % 2 = 0").drop("unit"), 0.65).select("id", "decision"), df.selectExpr("id", "'keep' as manual_decision"))[0],
    "revision_reaudit": lambda df: W.overlap_decision(df, df, 0.65, same_unit=False),
    "selection_audit": lambda df: W.selection_violations(df.selectExpr("id", "norm", "cast(unit as string) as dataset_split", "'x' as decision"), df, df.where("id < 0"), {}, ["norm"], [], 0.65).groupBy("violation").agg(F.count("*").alias("n")),
}


@pytest.mark.parametrize("name", COPIES)
def test_copies_are_compared_once(spark, monkeypatch, name):
    """A text that comes 100 times is one gram set, not 10,000 pairs of sets."""
    text = "".join(random.Random(5).choice(("ta", "re", "no", "li", "su", "mo", "ke")) for _ in range(60))
    df = spark.createDataFrame([(i, text, i % 3) for i in range(100)] + [(i, text + "x" * (i - 2639), 7) for i in range(2640, 2645)], SCHEMA)
    links, plain = [], C.similar_pairs

    def counted(*args, **more):
        out = plain(*args, **more)
        links.append(out.count())
        return out

    for module in (C, W):
        monkeypatch.setattr(module, "similar_pairs", counted, raising=False)
    COPIES[name](df).count()
    assert links and max(links) <= 36


def test_overlap_leaves_texts_and_not_their_gram_sets(spark):
    """Gram sets are many times their texts: neither they nor signatures stay on disk, and no join shuffles them."""
    import os

    from evidrill.sources.scratch import shared_folder

    folder = shared_folder(spark).removeprefix("file://") + "/evidrill"
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(800)) for _ in range(200)]
    mine = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = W.overlap_decision(mine, mine.selectExpr("id + 1000 as id", "norm || 'zq' as norm"), 0.65)
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith(("gram-sets", "signature"))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array<string>" not in plan and "grams" not in plan
    assert rows(out, "decision").count(("needs_review",)) == 200


def test_review_selection_audits_once(spark, sf):
    """What stays and what waits read the written audit; neither runs its joins again."""
    from evidrill.queries import reviews as Q

    files = Q.review_selection(spark, sf).inputFiles()
    assert files and all("/audited-" in f for f in files)


def test_revised_questions_are_taken_from_conversations_once(spark, sf):
    """The audits read the written first questions, and none gathers them from the conversations again."""
    from evidrill.queries import reviews as Q

    for df in Q._revised(spark, sf):
        assert not [f for f in df.inputFiles() if "conversations" in f]
