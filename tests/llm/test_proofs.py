"""Operators against slow and plain versions of the same, and held-out labels against guessing."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import pytest
import zstandard

from evidrill.llm import language, minhash, mixing, packing, quality, rules, scoring, toxicity
from evidrill.llm.common import key_remainder
from evidrill.llm.registry import pack_settings, tokenizer_file

SF = "/root/testdata/sf0.01"
VOCABULARY = scoring.LatticeSettings(vocabulary=tokenizer_file("byte_bpe_50k.tiktoken"), rounds=0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_by_hand(spark):
    """Counts, base and the mixed score of every text, from dictionaries and a memoized sum over segmentations."""
    rng = random.Random(8)
    words = ["the", "there", "dog", "Dogs", "été", "x" * 50, "new-word", "a"]
    texts = [" \t".join(rng.choice(words[: 3 + i % 6]) for _ in range(rng.randrange(0, 9))) for i in range(30)] + [None]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [[*scoring.lower_words((t or "").encode()), None] for t in texts]  # None: the end
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    vocabulary = scoring.read_vocabulary(VOCABULARY)
    scores = dict(zip(vocabulary, np.exp(scoring.initial_scores(vocabulary, VOCABULARY)).tolist()))

    def every(w, known={}):
        if w not in known:
            known[w] = 1.0 if not w else sum(scores[w[:k]] * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in scores)
        return known[w]

    def chance(w):
        d = VOCABULARY.discount
        return (c[None] - d) / n if w is None else max(c[w] - d, 0) / n + d * v / n * every(b" " + w)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.score_documents(df, VOCABULARY).collect()}
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(log10(chance(w)) for w in t))


def test_expected_uses_are_the_slope():
    """A piece's expected uses are the slope of a word's log probability in the piece's log score."""
    vocabulary = {bytes([i]): -3.0 for i in range(256)} | {b" a": -1.0, b"ab": -1.5, b"ba": -2.5, b"aba": -2.0, b"ab" * 10: -2.0}
    pieces, x = list(vocabulary), np.array(list(vocabulary.values()))
    words = [b" abab"] * 9 + [b" " + b"ab" * 12, b" " + b"ba" * 30]
    counts = scoring.Lattice(pieces, x).expected(words)
    for p in (b"ab", b"ba", b"aba", b"b", b"ab" * 10):
        up, down = x.copy(), x.copy()
        up[pieces.index(p)] += 1e-5
        down[pieces.index(p)] -= 1e-5
        slope = (scoring.Lattice(pieces, up).marginals(words).sum() - scoring.Lattice(pieces, down).marginals(words).sum()) / 2e-5
        assert counts[pieces.index(p)] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_pieces_are_found_in_crowded_slots():
    rng = random.Random(3)
    pieces = sorted({bytes([i]) for i in range(256)} | {bytes(rng.choices(b"abcd", k=rng.randrange(2, 9))) for _ in range(3000)})

    class Crowded(scoring.Lattice):
        slot_bits = 6

    score = np.log(np.arange(1.0, len(pieces) + 1) / 1e7)
    words = [bytes(rng.choices(b"abcd", k=12)) for _ in range(50)]
    plain = [scoring.word_score(w, dict(zip(pieces, score.tolist())), [8, 7, 6, 5, 4, 3, 2, 1]) for w in words]
    assert np.allclose(Crowded(pieces, score).marginals(words), plain)


def test_held_out_text_is_likelier_after_learning(spark, documents):
    """Per held-out token: the lattice with existing scores, and with scores re-estimated from them."""
    mean = []
    for rounds in (0, 2):
        s = scoring.LatticeSettings(vocabulary=VOCABULARY.vocabulary, rounds=rounds)
        r = scoring.score_documents(documents, s).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS m").first()
        mean.append(r.m)
    assert -6.0 < mean[0] < mean[1] and mean[1] > -5.0


def test_ftrl_against_one_coordinate_at_a_time():
    rng = random.Random(4)
    s = toxicity.FtrlSettings(bits=6, epochs=3, l1=0.3, l2=0.2)
    examples = []
    for _ in range(60):
        x = sorted(rng.sample(range(64), rng.randrange(0, 9)))
        examples.append((np.array(x, dtype=np.int64), int(3 in x or rng.random() < 0.1)))
    z, n = Counter(), Counter()

    def weight(i):
        if i != "bias" and abs(z[i]) <= s.l1:
            return 0.0
        l1, l2 = (0.0, 0.0) if i == "bias" else (s.l1, s.l2)
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((s.beta + n[i] ** 0.5) / s.alpha + l2)

    for _ in range(s.epochs):
        for x, y in examples:
            at = ["bias", *x.tolist()]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
    m = toxicity.fit_ftrl(examples, s)
    want = [weight(i) for i in range(64)]
    assert m.bias == pytest.approx(weight("bias")) and np.allclose(m.dense(), want)
    assert 0 < len(m.index) < 64  # L1 leaves some out


def test_features_are_words_pairs_and_skips():
    f = toxicity.features(b"You are a  clown", 20)
    assert len(f) == 4 + 3 + 2 and np.array_equal(f, toxicity.features(b"you ARE\na clown", 20))
    assert len(set(f) & set(toxicity.features(b"are you a clown", 20))) >= 4 + 1  # words, and one pair at least


def f1(pairs, cut):
    hit = sum(s >= cut and y for s, y in pairs)
    return 2 * hit / max(1, sum(s >= cut for s, _ in pairs) + sum(y for _, y in pairs))


@pytest.mark.parametrize(("name", "module", "cut"), [("toxic", toxicity, 0.5), ("quality", quality, 0.3)])
def test_held_out_labels_beat_guessing(documents, labels, name, module, cut):
    """F1 of the rarer label on a few held-out rows, where guesses by the labels' shares reach their share."""
    docs = documents.select("doc_id", "text")
    out = module.score_documents(docs, module.learn(docs, labels)).where(key_remainder("doc_id", 5) == 0).join(labels, "doc_id").collect()
    pairs = [(r.score, r[name]) for r in out if r[name] is not None]
    if name == "quality":  # the rarer label is 0
        pairs, cut = [(1 - s, 1 - y) for s, y in pairs], 1 - cut + 1e-12
    share = sum(y for _, y in pairs) / len(pairs)
    assert share < 0.3 and f1(pairs, cut) > 0.6


def test_vote_against_sorting_all_cosines():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.4, (60, 41)).astype(np.float32)
    labels = (counts[:, 0] > 0).astype(np.float32)
    s = quality.QualitySettings(trigram_dims=40, rank=8, neighbours=7)
    m = quality.fit_quality(counts, labels, s)
    new = rng.poisson(0.4, (25, 41)).astype(np.float32)
    got = quality.vote(new, m, s.neighbours)
    for c, score in zip(new, got):
        x = np.log1p(c) * m.idf
        x = (x / np.linalg.norm(x)) @ m.basis
        cosine = [float(v @ x / np.linalg.norm(x)) for v in m.vectors]
        near = sorted(range(60), key=lambda i: -cosine[i])[: s.neighbours]
        w = [max(cosine[i], 0.0) for i in near]
        assert score == pytest.approx(sum(a * labels[i] for a, i in zip(w, near)) / sum(w), abs=1e-4)


def test_counts_of_frequent_terms_are_whole(spark):
    """A trigram that occurs 200,000 times in a learned text counts so, as it does when the text is scored."""
    df = spark.createDataFrame([(1, "ab" * 200_000), (2, "cd ef gh")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.learn(df, marks, modulus=None)
    own = quality._unit(quality._weigh(np.stack([quality.term_counts(("ab" * 200_000).encode(), quality.QualitySettings().dims)]), m.idf) @ m.basis)
    assert (own @ m.vectors.T).max() == pytest.approx(1.0, abs=1e-5)


def test_languages_of_held_out_texts(documents):
    d = language.learn_dictionaries(documents.select("doc_id", "text", "lang"))
    held = documents.where((key_remainder("doc_id", 4) == 2) & documents.lang.isNotNull())
    rows = language.predict_language(held, d).select("text", "lang", "lang_pred", "score", "accepted").collect()
    said = [r for r in rows if r.lang_pred != "und"]
    majority = max(Counter(r.lang for r in said).values()) / len(said)
    assert majority < 0.8 and np.mean([r.lang == r.lang_pred for r in said]) > 0.95
    sure = [r.lang == r.lang_pred for r in said if r.accepted]
    assert np.mean(sure) >= np.mean([r.lang == r.lang_pred for r in said])
    s = language.LanguageSettings()
    for r in said[:40]:  # the smallest encoding, with coders made for each text
        body, best = language.letters(r.text), {}
        for lang, raw in d.items():
            coder = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            best[lang] = sum(len(coder.compress(body[i : i + s.block_bytes])) for i in range(0, len(body), s.block_bytes))
        assert best[r.lang_pred] <= min(best.values()) * 1.02


def test_cascade_verdicts_do_not_hang_on_the_order(documents):
    plan = rules.plan_cascade(documents)
    a = {r.doc_id: r.kept for r in rules.judge_documents(documents, plan).collect()}
    assert a == {r.doc_id: r.kept for r in rules.judge_documents(documents, plan[::-1]).collect()}
    every = {r.doc_id: not any(x.rejects(rules.Text((r.text or "").encode())) for x in rules.RULES) and not rules.base_failed(rules.Text((r.text or "").encode())) for r in documents.select("doc_id", "text").collect()}
    assert a == every


def test_cascade_runs_fewer_rules_on_rejected_documents(documents):
    plan = rules.plan_cascade(documents, before=rules.seen)
    worth = [m.rejected / m.seconds for m in plan if m.rejected]
    assert worth == sorted(worth, reverse=True)
    mean = lambda p: rules.apply_cascade(documents, p).where("rejected_by IS NOT NULL").agg({"rules_run": "avg"}).first()[0]
    assert mean(plan) < 0.7 * len(rules.RULES) and mean(plan) <= mean(plan[::-1])


def test_mixture_meets_targets_and_budget(documents):
    """Marginals of the raked weights, the expected tokens of the sample, and those of one draw."""
    s = mixing.MixSettings()
    cells = mixing.mixture(documents, s).toPandas()
    for d in mixing.DIMENSIONS:
        by = cells.groupby(d, dropna=False)
        assert np.abs(by["weight"].sum() - by[f"share_{d}"].first()).max() < 0.002, d
    assert (cells.tokens * cells.probability).sum() == pytest.approx(s.budget * cells.tokens.sum(), rel=0.01)
    report = mixing.fit_report(mixing.mixture(documents, s), s).collect()
    assert {r.dimension for r in report} == {*mixing.DIMENSIONS, "budget"} and max(r.missed for r in report) < 0.005
    out = mixing.add_probability(documents).select("kept", mixing.token_count().alias("n")).toPandas()
    assert out.n[out.kept].sum() / out.n.sum() == pytest.approx(s.budget, abs=0.1)


def test_padding_against_one_global_sort(documents):
    """Runs and partitions of a table cost little against best fit over all documents at once."""
    s = pack_settings()
    pieces = packing.pack_documents(documents, s).toPandas()
    sequences = pieces.sequence_id.nunique()
    tails = (pieces[pieces.start == 0].doc_tokens % s.window).tolist()
    full = int((pieces[pieces.start == 0].doc_tokens // s.window).sum())
    _, best = packing.best_fit([x for x in tails if x], s.window, 0, packing.OpenSequences(s.window))
    padding = 1 - pieces.length.sum() / (sequences * s.window)
    assert sequences <= 1.03 * (best + full) and padding < 0.05


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (2, text + " more", "c"), (3, "other words altogether here now", "d"), (3, "other words altogether here now", "d"), (None, text, "e"), (None, text, "e")]
    got = minhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __place string")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 3]


def test_long_documents_share_small_blocks(spark):
    """Blocks are cut by shingles too: near copies of long texts link as they do in one block."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    texts = []
    for i in range(14):
        t = list(base)
        for _ in range(6 * i):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [minhash.MinHashSettings(star_rounds=r, block_shingles=b) for r, b in ((0, 1500), (3, 1 << 20))]
    a, b = (sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, x).collect()) for x in s)
    assert a == b and len({c for _, c in a}) < 14


def test_log_space_holds_for_unlikely_words():
    lattice = scoring.Lattice([bytes([i]) for i in range(256)], np.full(256, -700.0))
    assert lattice.marginals([b" abcdef"])[0] == pytest.approx(-700.0 * 7) and log(1) == 0
