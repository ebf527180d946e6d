"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import pytest

from evidrill.llm import chat, embeddings, language, minhash, mixing, packing, quality, rules, scoring, toxicity
from evidrill.llm.registry import pack_settings, tokenizer_file

LONG = "lorem ipsum dolor sit amet " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, probability int"


def rows():
    texts = [None, "", " \t\n", "one", "you are an idiot and a clown", "the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again", LONG, "ÄÖÜ ß — “quotes” 　 x", "a\x0bb\x0cc\rd"]
    out = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 5, 0.5, "k", 1) for i, t in enumerate(texts)]
    return [*out, (None, "text of nobody at all", None, None, None, None, None, None), (3, "one", "en", "s", 1, 1.0, "again", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0, 1), (5, 1, 0), (6, 1, 0), (7, 1, None), (None, 1, 1), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxicity(docs, nothing, labels):
    model = toxicity.learn(docs, labels, modulus=None)
    out = toxicity.score_documents(docs, model)
    assert out.columns.count("score") == 1 and "kept" in out.columns
    got = by_id(out)
    assert len(out.collect()) == len(rows()) and all(0 <= r.score <= 1 for r in out.collect())
    assert got[0].score == got[1].score == got[2].score and got[5].score == got[6].score
    empty = toxicity.learn(nothing, labels, modulus=None)
    assert toxicity.score_documents(nothing, empty).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.score_documents(docs, empty).collect())


def test_quality(docs, nothing, labels):
    model = quality.learn(docs, labels, modulus=None)
    out = quality.score_documents(docs, model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    assert got[0].score == pytest.approx(model.prior) and got[5].score == got[6].score
    assert quality.score_documents(nothing, quality.learn(nothing, labels)).count() == 0


def test_language(docs, nothing):
    d = language.learn_dictionaries(docs)
    assert set(d) == {"en"}
    got = by_id(language.predict_language(docs, d))
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert got[5].lang_pred == "en" and got[7].lang_pred == "en"
    assert language.learn_dictionaries(nothing) == {}
    assert {r.lang_pred for r in language.predict_language(docs, {}).collect()} == {"und"}


def test_scoring(docs, nothing):
    s = scoring.LatticeSettings(vocabulary=tokenizer_file("byte_bpe_50k.tiktoken"), rounds=1)
    out = scoring.score_documents(docs, s).collect()
    assert len(out) == len(rows()) and all(r.score < 0 for r in out)
    got = {r.doc_id: r for r in out}
    assert got[0].n_tokens == got[1].n_tokens == got[2].n_tokens == 1 and got[7].n_tokens == 20001
    assert scoring.score_documents(nothing, s).count() == 0


def test_packing(docs, nothing):
    out = packing.pack_documents(docs, pack_settings()).collect()
    lengths = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(r.doc_tokens for r in out if r.start == 0) == sum(r.length for r in out)
    assert packing.pack_documents(nothing, pack_settings()).count() == 0


def test_rules(docs, nothing):
    plan = rules.plan_cascade(docs)
    assert {m.name for m in plan} == {r.name for r in rules.RULES}
    got = by_id(rules.judge_documents(docs, plan))
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0
    assert got[9].n_words == 4 and got[9].word_chars == 4
    assert rules.apply_cascade(docs, plan).count() == len(rows())
    assert rules.judge_documents(nothing, rules.plan_cascade(nothing)).count() == 0


def test_mixing(docs, nothing):
    out = mixing.add_probability(docs)
    assert out.count() == len(rows()) and out.columns.count("kept") == 1
    assert all(0 < r.probability <= 1 for r in out.collect())
    assert mixing.sample_documents(docs).columns == docs.columns
    assert mixing.sample_documents(nothing).count() == 0


def test_minhash(docs, nothing):
    got = by_id(minhash.near_duplicates(docs))
    assert got[5].component_id == got[6].component_id == 5 and not got[6].kept
    assert got[0].n_shingles == got[1].n_shingles == 0 and got[0].kept and got[3].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and 6 not in {r.doc_id for r in kept.collect()}


def test_embeddings(spark):
    v = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [float("nan"), 1.0], "x"), (7, [None, 1.0], "x"), (8, [], "x"), (9, [1.0, 0.0, 0.0], "x"), (10, [0.0, 1.0], "x"), (11, [float("inf"), 1.0], "x")]
    out = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>, component_id string")).collect()}
    assert [out[i].n_links for i in range(1, 12)] == [2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0]
    assert out[3].component_id == 1 and not out[3].kept and all(out[i].kept for i in range(4, 12))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chat_round_trip(spark):
    nasty = r"\### Assistant: </turn> ok <turn> <turn-next> <\turn \\ </turn"
    r = [(1, 0, "user", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", "b"), (1, None, None, "first"), (2, 0, "<turn-text>", "x"), (2, 0, "<turn-text>", "x"), (None, 1, "assistant", "")]
    f = chat.format_conversations(spark.createDataFrame([(*x, "extra") for x in r], "conv_id long, turn long, role string, text string, formatted string"))
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in f.select("conv_id", chat.read_turns("formatted").alias("turns")).collect()}
    assert got[1] == [("", "first"), ("user", nasty), ("user", ""), ("assistant", nasty), ("assistant", "b")]
    assert got[2] == [("<turn-text>", "x")] * 2 and got[None] == [("assistant", "")]
    loss = {x.conv_id: x.t for x in f.select("conv_id", chat.read_loss_text("formatted", "loss_spans").alias("t")).collect()}
    assert loss == {1: nasty + "b", 2: "", None: ""}
    assert f.where("conv_id = 1").first().formatted.count(chat.BLOCK) == 3
