from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evidrill.operators import chunking, contracts as K, curation as C, evaluation as E
from evidrill.queries import views as V
from evidrill.sources import files as S
from evidrill.streaming import events as ST


def grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    g = C.grams_of(df, "id", "t")
    for tau in (0.3, 0.65, 1.0):
        want = {}
        for i, j in combinations(range(len(texts)), 2):
            a, b = grams(texts[i]), grams(texts[j])
            if a and b and len(a & b) / len(a | b) >= tau:
                want[i, j] = round(len(a & b) / len(a | b), 9)
        got = {(r.left_id, r.right_id): round(r.similarity, 9) for r in C.similar_pairs(g, g, tau, self_join=True).collect()}
        assert got == want


def syllables(rng, words):
    return "".join(rng.choice(("ta", "re", "no", "li", "su", "mo", "ke", "pa", "di", "vu")) for _ in range(words))


def test_similar_texts_with_copies_and_all_sizes(spark):
    """Signatures of different lengths meet, and the rows of equal texts come back in every pair."""
    rng = random.Random(4)
    texts = [syllables(rng, rng.choice((1, 3, 20, 60, 400))) for _ in range(60)]
    texts += [t[: -rng.randrange(1, 9)] + "x" * rng.randrange(4) for t in texts[:40]] + [t * 2 + syllables(rng, 30) for t in texts[:20]] + texts[:9] * 2 + ["", ""]
    rng.shuffle(texts)
    want = {}
    for i, j in combinations(range(len(texts)), 2):
        a, b = grams(texts[i]), grams(texts[j])
        if a and b and len(a & b) / len(a | b) >= 0.65:
            want[i, j] = round(len(a & b) / len(a | b), 9)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    got = [((r.left_id, r.right_id), round(r.similarity, 9)) for r in C.similar_texts(df, 0.65).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_similar_pairs_write_little_where_all_grams_are_frequent(spark):
    """Texts of a few syllables share many grams with most others; neither grams nor such pairs must be shuffled to be counted."""
    rng = random.Random(8)
    texts = [syllables(rng, rng.randrange(40, 80)) for _ in range(1500)]
    g = C.grams_of(spark.createDataFrame(list(enumerate(texts + [texts[0] + "x"])), "id long, t string"), "id", "t")
    sc = spark.sparkContext._jsc.sc()
    written = lambda: (sc.listenerBus().waitUntilEmpty(), sc.statusStore().executorList(False).head().totalShuffleWrite())[1]
    before = written()
    pairs = {(r.left_id, r.right_id) for r in C.similar_pairs(g, g, 0.65, self_join=True).collect()}
    assert (0, 1500) in pairs and written() - before < 1 << 19


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51)]
    got = {r.id: r.component for r in C.independence_components(spark.createDataFrame(edges, "a long, b long"), spark.range(1, 60)).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[52] == 50 and got[59] == 59


def test_quota_selection_and_split():
    parts = [(i, c, s) for i, (c, s) in enumerate([((1, 0), (0, 3)), ((1, 0), (1, 1)), ((0, 1), (0, 9)), ((1, 1), (0, 1)), ((0, 2), (5, 5))])]
    assert C.select_by_quota(parts, (2, 1)) == [0, 1, 2] and C.select_by_quota(parts, (9, 9)) is None
    best = max((sum(s[0] for _, _, s in x), sum(s[1] for _, _, s in x)) for n in range(6) for x in combinations(parts, n) if tuple(map(sum, zip(*[c for _, c, _ in x]))) == (1, 2))
    chosen = C.select_by_quota(parts, (1, 2))
    assert (sum(parts[i][2][0] for i in chosen), sum(parts[i][2][1] for i in chosen)) == best
    assert C.grouped_split([("a", (3, 0), 1, 2), ("b", (2, 1), 2, 2), ("c", (5, 1), 0, 1)], (5, 1), 3) == ["a", "b"] and C.grouped_split([("a", (3, 0), 1, 2)], (5, 0), 1) is None


def test_shortlist_three_passes(spark):
    rows = [("s", 1, 1, "t", "a"), ("s", 2, 1, "u", "b"), ("s", 3, 2, "t", "c"), ("s", 4, 3, "v", "d"), ("s", 5, 3, "v", "e")]
    got = C.diverse_shortlist(spark.createDataFrame(rows, "g string, rank int, page_number int, topic string, id string"), "g", 4).orderBy("pick").collect()
    assert [r.id for r in got] == ["a", "d", "c", "b"]


def shortlist(rows, limit):
    """The reference's three passes over rows of (order, page, topic, id)."""
    picked = []
    for fits in (lambda r: r[2] is not None and r[1] not in {x[1] for x in picked} and r[2] not in {x[2] for x in picked}, lambda r: r[1] not in {x[1] for x in picked}, lambda r: True):
        for r in sorted(rows, key=lambda r: r[0]):
            if len(picked) < limit and r not in picked and fits(r):
                picked.append(r)
    return [r[3] for r in picked]


def test_shortlist_leaves_out_no_row_that_counts(spark):
    rng, groups = random.Random(6), {}
    for g in range(120):
        pages, topics = rng.choice([1, 2, 6, 90]), rng.choice([1, 3, 9, 90])
        n = rng.choice([3, 30, 300])
        # pages and topics of low numbers come first, so that later ones stand behind many that do not fit
        groups[g] = [(k, rng.randrange(1 + k * pages // n), None if (t := rng.randrange(1 + k * topics // n)) == 2 else f"t{t}", f"i{k}") for k in range(n)]
    df = spark.createDataFrame([(g, *r) for g, x in groups.items() for r in x], "g int, rank int, page_number int, topic string, id string").repartition(5)
    for limit in (2, 5):
        got = {}
        for r in C.diverse_shortlist(df, "g", limit).orderBy("g", "pick").collect():
            got.setdefault(r.g, []).append(r.id)
        assert got == {g: shortlist(x, limit) for g, x in groups.items()}


def test_shortlist_query_walks_whole_sources(spark, tmp_path):
    """The only document of another language stands behind 60 of the first, on the last page."""
    from evidrill.queries.curation import diverse_shortlist

    docs = [(i * V.SOURCES, "x" * 600, "en", "s") for i in range(60)] + [(60 * V.SOURCES, "y" * 2000, "fr", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.page_number, r.topic) for r in diverse_shortlist(spark, str(tmp_path)).orderBy("pick").collect()]
    assert got == [(1, "en"), (61, "fr"), (2, "en"), (3, "en"), (4, "en")]


def test_passes_and_overlay(spark):
    df = spark.createDataFrame([(1, " yes ", "yes", '["a","b"]', '["b","a"]'), (2, "x", "y", "[]", None)], "id int, pass1_d string, pass2_d string, pass1_l string, pass2_l string")
    got = {r.id: r.disagreements for r in C.compare_passes(df, ["d"], ["l"]).collect()}
    assert got == {1: [], 2: ["d"]}


def test_leakage_reasons_in_order(spark):
    c = spark.createDataFrame([(1, "q", "s"), (2, "z", "s"), (3, "z", "y")], "id int, question string, source string")
    ref = spark.createDataFrame([("q", "s"), ("q", "s")], "question string, source string")
    got = {r.id: r.reasons for r in C.leakage_reasons(c, ref, [("exact_question", ["question"]), ("source", ["source"])]).collect()}
    assert got == {1: ["exact_question", "source"], 2: ["source"], 3: []}


def test_contracts_fail_closed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(K.ContractError):
        K.equal_join(a, a.where("k = 1"), ["k"], "join")
    with pytest.raises(K.ContractError):
        K.equal_join(a.union(a), a, ["k"], "join")
    assert K.equal_join(a, a.withColumnRenamed("v", "w"), ["k"], "join").count() == 2
    with pytest.raises(K.ContractError):
        K.project_runtime(a.withColumn("gold_answer", F.lit(1)), ["k", "gold_answer"])
    with pytest.raises(K.ContractError):
        K.same_table(a, a.where("k = 1"), "runs")
    K.same_table(a, a.repartition(3), "runs")
    out, refused = K.compare_and_swap(a, ["k"], "v", spark.createDataFrame([(1, "x", "new"), (2, "wrong", "new"), (9, "x", "n")], "k int, expected_old string, new_value string"))
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "new"), (2, "y")] and refused.count() == 2


def test_write_once(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    path = f"file://{tmp_path}/t"
    assert S.write_once(a, path) and not S.write_once(a, path)
    with pytest.raises(K.ContractError):
        S.write_once(a.union(a), path)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": 1, "x": "é"}\n\n{"id": 2}\n', encoding="utf-8")
    assert [(r.id, r.x) for r in S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, x string").collect()] == [(1, "é"), (2, None)]
    (tmp_path / "reg.md").write_text("| A1 | s.pdf | 3 |\nno\n", encoding="utf-8")
    assert S.read_registry(spark, str(tmp_path / "reg.md"), r"^\| (A\d+) \| (\S+) \| (\d+) \|$", ["anchor", "source", "page"]).first() == ("A1", "s.pdf", "3")
    assert S.latest_run(spark, f"file://{tmp_path}", "r") == "reg.md"


def test_markdown_table(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["1", None, "x"], ["2\n3"]]), (2, [["only"]]), (3, None)], "i int, rows array<array<string>>")
    got = [r.m for r in df.orderBy("i").select(S.table_to_markdown("rows").alias("m")).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 |  |\n| 2 3 |  |", "", ""]


def test_chunk_tail(spark):
    df = spark.createDataFrame([(1, "text", "。".join(["一" * 14] * 3) + "。"), (2, "table", "| a |"), (3, "text", None)], "block_id long, block_type string, content string")
    got = chunking.chunk_blocks(df).where("granularity = 128").orderBy("block_id", "chunk_in_block").collect()
    assert [len(r.content) for r in got] == [45, 30, 15, 5]
    assert chunking.chunk_blocks(df, drop_suffixes=True).where("granularity = 128").count() == 2


RANKING = "query_id long, method_id string, rank int, source_file string, page_number int"


def test_metrics_of_one_question(spark):
    r = spark.createDataFrame([(1, "m", 1, "other.pdf", 3), (1, "m", 2, "G uide.pdf", 26), (1, "m", 3, "guide.pdf", 25)], RANKING)
    gold = spark.createDataFrame([(1, "Guide.PDF", 26)], "query_id long, source_file string, page_number int")
    m = E.retrieval_metrics(r, gold).first()
    assert (m.source_hit, m.strict_hit, m.mrr, m.failure_type) == (1, 1, 0.5, "gold_source_page_hit")
    assert m.source_precision == pytest.approx(2 / 3) and m.page_precision == pytest.approx(1 / 3)


def test_budget_curve(spark):
    rows = [(1, "m", b, i, "g", 9 if i == 21 else 1) for b in (20, 40, 80) for i in range(1, min(b, 30) + 1)]
    r = spark.createDataFrame(rows, "query_id long, method_id string, budget int, rank int, source_file string, page_number int")
    gold = spark.createDataFrame([(1, "g", 9)], "query_id long, source_file string, page_number int")
    got = {x.budget: x for x in E.budget_curve(r, gold, (20, 40, 80), 1).collect()}
    assert [got[b].strict_hits for b in (20, 40, 80)] == [0, 1, 1] and got[40].mrr == pytest.approx(1 / 21) and [got[b].new_hits for b in (20, 40, 80)] == [0, 1, 0]


def test_failure_and_freeze(spark):
    r = spark.createDataFrame([(1, "dense", "A", 10), (1, "sparse", "B", 3), (1, "rrf", "B", 3)], "query_id long, method_id string, source_file string, page_number int")
    assert E.failure_taxonomy(r, spark.createDataFrame([(1, "A", 10)], "query_id long, source_file string, page_number int")).first().failure == "fusion_dropped_valid_dense"
    rule = lambda a, b: spark.range(1).select(E.freeze_candidate(F.lit(a), F.lit(b))).first()[0]
    assert rule(0.05, 0.0) and not rule(0.0, 0.0) and not rule(0.05, -0.05)


def test_relay_stream_equals_batch(spark, tmp_path):
    req = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, True)], "session_id long, b boolean, f boolean")
    batch = ST.relay_events(req, F.col("b"), F.col("f"))
    assert {r.session_id: (r.updates, r.state) for r in ST.session_state(batch).collect()} == {1: (4, "done"), 2: (1, "done"), 3: (0, "error")}
    req.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(req.schema).parquet(f"file://{tmp_path}/in")
    q = ST.run_on_requests(stream, lambda df: ST.relay_events(df, F.col("b"), F.col("f")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_event_lines(spark):
    df = spark.createDataFrame([(1, 0, 'data: {"type": "start"}'), (1, 1, "data: {bad"), (1, 2, ": ping"), (1, 3, 'data: {"type": "done"}')], "session_id long, seq int, line string")
    assert [r.type for r in ST.parse_events(df).orderBy("seq").collect()] == ["start", "done"]
