from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidrill.functions import rules, text
from evidrill.operators import retrieval as R


def test_exact_top_k_breaks_ties_by_key(spark):
    rows = [("b", "c", [1.0, 0.0]), ("a", "c", [0.0, 1.0]), ("c", "c", [-1.0, 0.0])]
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, query_vector array<float>")
    for order in (rows, rows[::-1]):
        v = spark.createDataFrame(order, "candidate_key string, collection string, embedding array<float>").repartition(3)
        got = R.dense_top_k(v, q, 2).orderBy("route_rank").collect()
        assert [(r.candidate_key, r.distance, r.route_rank) for r in got] == [("a", 1.0, 1), ("b", 1.0, 2)]
        assert got[0].route == "dense_exact:c" and got[0].raw_score == 0.0


def test_rrf_scores_and_traces(spark):
    rows = [(1, "detail_128::a", "dense:d", 1, 0.9), (1, "detail_128::a", "sparse:d", 2, 3.0), (1, "concept_512::a", "dense:c", 1, 0.5)]
    got = R.rrf(spark.createDataFrame(rows, "query_id long, candidate_key string, route string, route_rank int, raw_score double"), 60, 20).orderBy("rank").collect()
    assert [r.candidate_key for r in got] == ["detail_128::a", "concept_512::a"]
    assert got[0].rrf_score == pytest.approx(1 / 61 + 1 / 62) and len(got[0].route_traces) == 2


def test_rerank_orders_by_score(spark):
    pool = spark.createDataFrame([(1, "d::1", 0.03, 0.2), (1, "d::2", 0.02, 0.9)], "query_id long, candidate_key string, rrf_score double, s double")
    got = {r.candidate_key: (r.pre_rerank_rank, r.post_rerank_rank) for r in R.rerank(pool, F.col("s")).collect()}
    assert got == {"d::1": (1, 2), "d::2": (2, 1)}


def test_model_scorer_checks_its_count(spark):
    df = spark.createDataFrame([("q", "abc")], "q string, c string")
    assert df.select(R.model_scorer(lambda pairs: [len(c) for _, c in pairs])("q", "c")).first()[0] == 3.0
    with pytest.raises(Exception, match="another number"):
        df.select(R.model_scorer(lambda pairs: [])("q", "c")).collect()


POOL = "query_id long, rank int, candidate_key string, content string, source_file string, page_number int"


def test_greedy_dedup_on_the_four_row_pool(spark):
    rows = [(1, 1, "d::1", "儿童肺炎应在四十八小时后复评疗效", "g.pdf", 3), (1, 2, "d::2", "儿童肺炎，应在四十八小时后复评疗效。", "g.pdf", 3), (1, 3, "d::3", "儿童肺炎应在四十八小时后复评疗效并记录", "g.pdf", 3), (1, 4, "x::4", "肾功能监测", "h.pdf", 1)]
    got = R.greedy_dedup(spark.createDataFrame(rows, POOL), 0.75).orderBy("evidence_rank").collect()
    assert [r.candidate_key for r in got] == ["d::1", "x::4"]
    assert (got[0].seen, got[0].exact, got[0].overlap) == (4, 1, 1)


def brute_dedup(rows, threshold, limit):
    kept = []
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()
    for r in sorted(rows, key=lambda r: r[1]):
        if len(kept) >= limit:
            break
        t = "".join(c for c in r[3].lower() if c.isascii() and c.isalnum())
        if not r[4] or r[5] <= 0 or any(t == k[1] for k in kept):
            continue
        g = grams(t)
        near = any(k[0][4] == r[4] and k[0][5] == r[5] and min(len(g), len(k[2])) and len(g & k[2]) >= threshold * min(len(g), len(k[2])) for k in kept)
        if not near:
            kept.append((r, t, g))
    return [k[0][2] for k in kept]


def test_greedy_dedup_against_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for q in range(30):
        for i in range(12):
            rows.append((q, i + 1, f"k{i}", "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 14))), rng.choice(["s", "t", ""]), rng.randrange(0, 3)))
    got = {}
    for r in R.greedy_dedup(spark.createDataFrame(rows, POOL).repartition(5), 0.75).orderBy("query_id", "evidence_rank").collect():
        got.setdefault(r.query_id, [])
        if r.candidate_key:
            got[r.query_id].append(r.candidate_key)
    assert got == {q: brute_dedup([r for r in rows if r[0] == q], 0.75, 4) for q in range(30)}


def test_admission_counts_beyond_the_cap(spark):
    rows = [(1, i, f"k{i}", t, s, p) for i, (t, s, p) in enumerate([("a", "", 1), ("g", "g.pdf", 1), ("one", "g.pdf", 1), ("one!", "g.pdf", 1), ("two", "g.pdf", 1), ("three", "g.pdf", 2)], 1)]
    got = [r.reason for r in R.admit_evidence(spark.createDataFrame(rows, POOL), 2).orderBy("rank").collect()]
    assert got == ["invalid_provenance", "title_only", "admitted", "duplicate", "admitted", "over_limit"]


@pytest.mark.parametrize(
    ("parts", "weights", "score", "level"),
    [((8, 9, 0.9), (0.4, 0.6), 7.74, "TRUSTED"), ((6, 8, 1), (0.3, 0.7), 7.4, "WARNING"), ((7.5, 7.5, 1), (0.4, 0.6), 7.5, "TRUSTED"), ((6, 7, 1), (0.4, 0.6), 6.6, "WARNING"), ((5, 5, 1), (0.4, 0.6), 5.0, "REJECTED"), ((8, 8, 0.5), (0.4, 0.6), 4.0, "REJECTED"), ((99, -1, 2), (0.4, 0.6), 4.0, "REJECTED")],
)
def test_trust(spark, parts, weights, score, level):
    s, g = R.trust_score(*[F.lit(float(p)) for p in parts], *weights)
    r = spark.range(1).select(s.alias("s"), g.alias("g")).first()
    assert (r.s, r.g) == (pytest.approx(score), level)


def test_rules_of_the_service(spark):
    q = "阿奇霉素和头孢能同时用吗，基本药物目录可以作为依据吗"
    df = spark.createDataFrame([(q, "国家基本药物目录（2018年版）.pdf", "联合用药 3种"), (q, "儿童肺炎支原体肺炎诊疗指南.pdf", "阿奇霉素 头孢 治疗"), ("普通问题", "x.pdf", "无")], "query string, source_file string, content string")
    a, b, c = df.select(rules.boost("query", "source_file", "content").alias("f"), rules.authority_weight("source_file").alias("w"), rules.expand_query("query").alias("e"), rules.required_terms_state("query", "content")[1].alias("met")).collect()
    assert a.f == pytest.approx(1.45 * 1.75) and b.f == pytest.approx(1.12) and c.f == 1.0
    assert (a.w, b.w, c.w) == (1.0, 0.9, 0.5) and c.e == "普通问题"
    assert a.e.startswith(q + " antimicrobial combination") and not a.met and b.met


def test_noise(spark):
    texts = ["", "## 参考文献\n[1] a", "**==> picture [1 x 2] intentionally omitted <==**", "# 儿童肺炎", "推荐剂量为每日一次，静脉滴注，疗程七天。", "附录 国家基本药物目录2018年版", "a long enough line without any signal words"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rules.is_noise("t").alias("n")).collect()]
    assert got == [True, True, True, True, False, True, False]


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.norm_text(F.lit("Ab-C 肺炎，１ß"))) == "abc肺炎"
    assert one(text.norm_question(F.lit("ＡＢ １"))) == "ab1"
    assert one(text.stem(F.lit("a.b.pdf"))) == "a.b" and one(text.slug(F.lit(" A-b c!"))) == "a_b_c"
    assert one(text.split_sentences(F.lit("剂量10.5mg。 好！\n尾"))) == ["剂量10.", "5mg。", "好！", "尾"]
    assert one(text.split_claims(F.lit("一，。二！ 三.四"))) == ["一", "二", "三.四"]
    assert one(text.char_ngrams(F.lit("abcd"))) == ["abc", "bcd"] and one(text.char_ngrams(F.lit("ab"))) == ["ab"] and one(text.char_ngrams(F.lit(""))) == []
    grams = lambda s: text.char_ngrams(F.lit(s))
    assert one(text.jaccard(grams("儿童肺炎复评"), grams("儿童肺炎评估"))) == pytest.approx(1 / 3)
    assert one(text.jaccard(grams(""), grams(""))) == 1.0 and one(text.overlap_coefficient(grams("abcd"), grams("xabcdx"))) == 1.0
    assert one(text.compact_text(F.lit("a  b\nc d e"), 7)) == "a b..." and one(text.tokens_by_prompt(F.lit(""))) == 0


def test_required_terms_union_and_fallback(spark):
    q = "阿奇霉素用药前要监测什么"
    rows = [(1, q, "阿奇霉素 说明"), (1, q, "药师审核"), (1, q, "别的"), (2, "红霉素剂量", "别的"), (3, "问题", "别的")]
    got = R.required_term_filter(spark.createDataFrame(rows, "query_id long, query string, content string")).orderBy("query_id", "filter_class").collect()
    assert [(r.query_id, r.content) for r in got] == [(1, "阿奇霉素 说明"), (1, "药师审核"), (3, "别的")]


def test_lexical_fallback(spark):
    chunks = spark.createDataFrame([("k1", 128, "NICE_NG143_Fever_in_under_5s.pdf", "Paracetamol and ibuprofen for fever"), ("k2", 512, "NICE_NG143_Fever_in_under_5s.pdf", "nothing here"), ("k3", 128, "x.pdf", "fever")], "candidate_key string, granularity int, source_file string, content string")
    got = R.lexical_fallback(chunks, spark.createDataFrame([(1, "孩子发热"), (2, "其他")], "query_id long, query string")).collect()
    assert [(r.query_id, r.candidate_key) for r in got] == [(1, "k1")] and got[0].relevance_score == pytest.approx(0.52 + 0.40 * 3 / 7)


def test_evidence_window_against_the_loop(spark):
    """At most one neighbour a seed, by overlap with the question, then nearest, then before."""
    rng = random.Random(8)
    seeds = [(q, f"s{rng.randrange(2)}", rng.randrange(1, 9), f"k{q}-{r}", r) for q in range(25) for r in range(1, 5)]
    pages = [(f"s{s}", p, f"s{s}p{p}", rng.choice([0.0, 0.5, 1.0])) for s in range(2) for p in range(1, 10)]
    a = spark.createDataFrame(seeds, "query_id int, source_file string, page_number int, candidate_key string, seed_rank int")
    near = R.neighbour_pages(a, spark.createDataFrame(pages, "source_file string, page_number int, candidate_key string, overlap double"), 2)
    by_parent, want = {}, []
    for r in near.collect():
        by_parent.setdefault((r.query_id, r.source_file, r.seed_page), []).append(r)
    for final_k, most in ((4, 1), (6, 2), (4, 0)):
        want = []
        for q in range(25):
            chosen, seen = [], set()
            for s in (s for s in seeds if s[0] == q):
                if s[1:3] not in seen:
                    chosen.append(s[3])
                    seen.add(s[1:3])
                n = 0
                for x in sorted(by_parent.get(s[:3], []), key=lambda x: (-x.overlap, abs(x.offset), x.offset)):
                    if n < most and (x.source_file, x.page_number) not in seen:
                        chosen.append(x.candidate_key)
                        seen.add((x.source_file, x.page_number))
                        n += 1
            want += [(q, i + 1, c) for i, c in enumerate(chosen[:final_k])]
        got = R.evidence_window(a, near, final_k, most).select("query_id", "position", "candidate_key").collect()
        assert sorted(map(tuple, got)) == want


def test_quota_violations(spark):
    from evidrill.operators.audits import quota_violations

    rows = [(1, "a", 1), (1, "a", 1), (1, "a", 2), (1, "b", 1), (1, None, None), (2, "a", 1), (2, "a", 2)]
    got = quota_violations(spark.createDataFrame(rows, "query_id int, source_file string, page_number int"), 2, 1).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 0, 0)]
