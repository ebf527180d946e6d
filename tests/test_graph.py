from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from evidrill.functions.constraints import constraints_of, extract_constraints, local_clause, merge_constraints, stance
from evidrill.operators import graph as G


def values(text):
    return {(t, v) for t, v, _ in constraints_of(text)}


def test_patterns():
    assert {("dose", "10mg/kg"), ("frequency", "bid"), ("route", "iv_infusion")} <= values("儿童支原体肺炎阿奇霉素静滴 10mg/kg，一天两次可以吗？")
    got = values("重症推荐阿奇霉素静点，10 mg/(kg.d)，qd。")
    assert {("dose", "10mg/kg/day"), ("frequency", "qd"), ("route", "iv_infusion"), ("evidence_scope", "dose_guidance")} <= got and ("dose", "10mg/kg") not in got
    assert {("monitoring_window", "48-72h"), ("monitoring_trigger", "nonresponse"), ("monitoring_action", "reassess")} <= values("所有患者经48～72小时治疗症状无改善，应再次进行临床或实验室评估。")
    assert ("combination_antipyretic", "coadministration") in values("布洛芬和对乙酰氨基酚能同时使用吗") and values("") == set() and values(None) == set()


def test_long_table_merges(spark):
    df = spark.createDataFrame([("a", "content", "qd 每日一次"), ("a", "content", "QD"), ("b", "content", None)], "owner_id string, scope string, text string")
    got = merge_constraints(extract_constraints(df)).collect()
    assert [(r.owner_id, r.ctype, r.cvalue) for r in got] == [("a", "frequency", "qd")] and sorted(got[0].surface_forms) == ["QD", "qd", "每日一次"]


def test_stance_near_a_surface(spark):
    df = spark.createDataFrame([("不推荐静滴，可口服", "静滴"), ("不推荐静滴，可口服", "口服"), ("do not use", "x")], "t string, s string")
    assert [r.x for r in df.select(stance(local_clause(F.col("t"), F.col("s"))).alias("x")).collect()] == ["reject", "assert", "reject"]


def greedy(rows, total, per_source, per_page):
    s, p, out, n = Counter(), Counter(), [], 0
    for key, source, page in rows:
        if p[source, page] >= per_page:
            out.append("source_page_quota")
        elif s[source] >= per_source:
            out.append("source_quota")
        elif n >= total:
            out.append("total_quota")
        else:
            out.append("selected")
            n += 1
            s[source] += 1
            p[source, page] += 1
    return out


def test_quota_windows_equal_the_loop(spark):
    rng = random.Random(4)
    rows = [(q, f"{i:03d}", rng.choice("abc"), rng.randrange(3)) for q in range(60) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "query_id long, candidate_key string, source_file string, page_number int").repartition(7)
    got = {}
    for r in G.route_with_quotas(df, 4, 2, 1, order=("candidate_key",)).orderBy("query_id", "raw_rank").collect():
        got.setdefault(r.query_id, []).append(r.route_decision)
    assert got == {q: greedy([x[1:] for x in rows if x[0] == q], 4, 2, 1) for q in {r[0] for r in rows}}


def test_expansion_budget(spark):
    base = spark.createDataFrame([(1, "base-1", 1), (1, "base-2", 2), (2, "only", 1)], "query_id long, candidate_key string, rank int")
    graph = spark.createDataFrame([(1, "graph-1", 1), (1, "base-1", 2)], "query_id long, candidate_key string, graph_rank int")
    run = lambda quota: [(r.query_id, r.candidate_key) for r in G.expand_with_budget(base, graph, 2, quota).orderBy("query_id", "expanded_rank").collect()]
    assert run(1) == [(1, "base-1"), (1, "graph-1"), (2, "only")]
    assert run(0) == [(1, "base-1"), (1, "base-2"), (2, "only")]


def test_no_shift_is_identity(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.9), (1, "c", 3, None)], "query_id long, candidate_key string, rank int, path_score double")
    order = lambda s: [r.candidate_key for r in G.shift_ranks(df, s).orderBy("new_rank").collect()]
    assert order(0.0) == ["a", "b", "c"] and order(2.0) == ["b", "a", "c"]


CONS = "query_id long, candidate_key string, scope string, ctype string, cvalue string"


def test_query_and_evidence_labels(spark):
    q = spark.createDataFrame([(1, "frequency", "qd"), (2, "frequency", "bid"), (3, "age_group", "infant"), (4, "dose", "x")], "query_id long, ctype string, cvalue string")
    e = spark.createDataFrame([(1, "k", "content", "frequency", "qd"), (2, "k", "content", "frequency", "qd"), (3, "k", "context", "age_group", "adult")], CONS)
    got = {r.query_id: r for r in G.compare_query_to_evidence(q, e, ["frequency"], ["dose"], ["age_group"]).collect()}
    assert got[1].supported_match and got[2].corrective_value_mismatch and got[3].scope_mismatch and got[4].coverage_gap


def test_evidence_pairs(spark):
    rows = [(1, k, "content", "frequency", v) for k, v in (("a", "qd"), ("b", "bid"))] + [(1, k, "context", t, v) for k in "ab" for t, v in (("medication", "m"), ("age_group", "child"))]
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, candidate_key string, rank int")
    got = {(r.left_key, r.right_key): r.label for r in G.compare_evidence_pairs(spark.createDataFrame(rows, CONS), ranks, ["frequency"], ["medication"], ["age_group"]).collect()}
    assert got == {("a", "b"): "evidence_evidence_conflict", ("a", "c"): "not_comparable", ("b", "c"): "not_comparable"}


def test_audit_of_values(spark):
    q = spark.createDataFrame([(1, "dose", "10mg/kg"), (1, "route", "iv_unspecified"), (1, "route", "iv_infusion"), (1, "frequency", "qd"), (1, "age_group", "x")], "query_id long, ctype string, cvalue string")
    e = spark.createDataFrame([(1, "dose", "10mg/kg/day"), (1, "route", "iv_infusion"), (1, "frequency", "bid")], "query_id long, ctype string, cvalue string")
    got = {(r.ctype, r.cvalue): r.status for r in G.audit_constraints(q, e).collect()}
    assert got == {("dose", "10mg/kg"): "matched", ("route", "iv_unspecified"): "matched", ("route", "iv_infusion"): "matched", ("frequency", "qd"): "conflict", ("age_group", "x"): "unsupported"}


def test_graph_violations(spark):
    q = spark.createDataFrame([(1, "dose", "a")], "query_id long, ctype string, cvalue string")
    e = spark.createDataFrame([(1, "k", "dose", "b")], "query_id long, candidate_key string, ctype string, cvalue string")
    nodes, edges = G.constraint_graph(q, e)
    assert G.graph_violations(nodes, edges).count() == 0 and {r.edge_type for r in edges.collect()} == {"REQUIRES", "MATCHES_TYPE", "CONFLICTS"}
    bad = G.graph_violations(nodes.where("node_type <> 'query'"), edges)
    assert {r.violation for r in bad.collect()} == {"missing_endpoint", "root_count"}


def test_claims(spark):
    c = spark.createDataFrame([("a", "1", "frequency", "qd", "assert"), ("a", "2", None, None, "assert"), ("b", "1", "frequency", "bid", "assert"), ("c", "1", "frequency", "bid", "reject")], "answer_id string, claim_id string, ctype string, cvalue string, stance string")
    e = spark.createDataFrame([(x, "frequency", "qd") for x in "abc"], "answer_id string, ctype string, cvalue string")
    got = {(r.answer_id, r.claim_id): r.claim_state for r in G.align_claims(c, e).collect()}
    assert got == {("a", "1"): "supported", ("a", "2"): "insufficient_evidence", ("b", "1"): "contradicted", ("c", "1"): "supported"}
    overall = {r.answer_id: r.overall_state for r in G.overall_state(G.align_claims(c, e)).collect()}
    assert overall == {"a": "insufficient_evidence", "b": "contradicted", "c": "supported"}
