"""Operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import random
from dataclasses import replace
from itertools import combinations
from math import exp, log

import numpy as np
import pytest

from evidrill.llm import embeddings, language, minhash, packing, quality, scoring, toxicity
from evidrill.llm.components import connected_components
from evidrill.llm.registry import pack_settings, tokenizer_file


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components_of({x for e in real for x in e}, real)
    assert got == want


def test_minhash_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(5):
            t = list(b)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    sets = [set(minhash.shingle_hashes(t.encode(), 4).tolist()) for t in texts]
    edges = [(i, j) for i, j in combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components_of(range(len(texts)), edges)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), minhash.MinHashSettings(shingle=4)).collect()}
    assert got == want and len(edges) > 50


def test_minhash_blocks_finish_what_stars_leave(spark):
    """With no star rounds and tiny blocks every link comes from the blocks."""
    texts = [" ".join(f"w{k}" for k in range(i, i + 40)) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = minhash.MinHashSettings(shingle=4, star_rounds=0, block=3)
    a = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, s).collect())
    assert a == sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, minhash.MinHashSettings(shingle=4)).collect())
    assert {c for _, c in a} == {0}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    v = np.concatenate([c + 0.02 * rng.standard_normal((rng.integers(1, 9), 64)) for c in centres] + [rng.standard_normal((150, 64))]).astype(np.float32)
    v = np.concatenate((v, v[:5]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    for s in (embeddings.CrossPolytopeSettings(), embeddings.CrossPolytopeSettings(block=3)):
        got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), s).collect()}
        links = np.array([got[i].n_links for i in range(len(v))])
        assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()  # none below the threshold, nearly all above
    want = components_of(range(len(v)), np.argwhere(near).tolist())
    assert sum(got[i].component_id == want[i] for i in want) >= 0.98 * len(v)


def pairs_at(cosine, n, dim):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_embedding_recall_at_every_size(dim):
    """Pairs at the threshold meet as often with the hashes of a huge table as with those of a small one."""
    a, b = pairs_at(0.95, 2000, dim)
    for vectors in (10**3, 10**5, 10**7, 10**9):
        s = embeddings.CrossPolytopeSettings(hashes=embeddings.hashes_for(vectors, dim, embeddings.CrossPolytopeSettings()))
        s = replace(s, tables=embeddings.tables_for(dim, s))
        x, y = embeddings.bucket_keys(a, s), embeddings.bucket_keys(b, s)
        assert sum(not np.isin(p, q).any() for p, q in zip(x, y)) <= 4, (dim, s.hashes)


def test_embeddings_with_the_hashes_of_a_huge_table(spark):
    a, b = pairs_at(0.951, 500, 64)
    v = np.concatenate((a, b))
    near = v @ v.T >= 0.95
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, embeddings.CrossPolytopeSettings(hashes=5)).agg({"n_links": "sum"}).first()[0]
    assert 0.995 * (near.sum() - len(v)) <= got <= near.sum() - len(v)


def test_embeddings_of_another_length_take_no_links(spark):
    """Near copies of 64 components, with a few of 63 and 33 that begin as they do."""
    rng = np.random.default_rng(4)
    v = [c + 0.02 * rng.standard_normal(64) for c in rng.standard_normal((6, 64)) for _ in range(5)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(100 + i, v[5 * i][:63].tolist()) for i in range(6)] + [(200 + i, v[i][:33].tolist()) for i in range(2)]
    for s in (embeddings.CrossPolytopeSettings(), embeddings.CrossPolytopeSettings(block=3)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), s).collect()}
        assert all(got[i] == (4, i // 5 * 5) for i, _ in rows)
        assert all(got[100 + i] == (0, 100 + i) for i in range(6)) and got[200] == got[201] == (1, 200)


def test_few_long_documents_fill_a_dictionary(spark):
    """Four long documents of a rare language fill its dictionary, from their ends too, beside many short ones of another."""
    rng = random.Random(2)
    rare = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(7000)) + " finale" + "xyzv"[k] * 3 for k in range(4)]
    common = [" ".join("".join(rng.choice("qrstuvw") for _ in range(6)) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "rare" if i < 4 else "common") for i, t in enumerate(rare + common)], "doc_id long, text string, lang string")
    s = language.LanguageSettings()
    d = language.learn_dictionaries(df, s, modulus=1, held=1)
    assert len(d["rare"]) >= 0.95 * s.dictionary_bytes
    for t in rare:  # each quarter of each text has its share
        for q in range(4):
            part = t.encode()[q * len(t) // 4 : (q + 1) * len(t) // 4]
            assert sum(d["rare"][i : i + 60] in part for i in range(0, len(d["rare"]), 200)) >= 10


def test_lattice_against_enumeration():
    vocabulary = {bytes([i]): -3.0 for i in range(256)} | {b" a": -1.0, b"ab": -1.5, b" ab": -2.0, b"ba": -2.5}

    def every(w):
        if not w:
            return 1.0
        return sum(exp(vocabulary[w[:k]]) * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in vocabulary)

    lattice = scoring.Lattice(list(vocabulary), np.array(list(vocabulary.values())))
    words = [b" ab", b" abab", b" b", b" aabba"] * 3
    assert np.allclose(lattice.marginals(words), [log(every(w)) for w in words])
    counts = dict(zip(vocabulary, lattice.expected(words)))
    assert sum(len(p) * c for p, c in counts.items()) == pytest.approx(sum(map(len, words)))


def test_long_words_teach_and_long_pieces_count():
    """A word of over 48 bytes is weighed like the same bytes in the matrix, and no piece is left out for its length."""
    vocabulary = {bytes([i]): -3.0 for i in range(256)} | {b" a": -1.0, b"ab": -1.5, b"ba": -2.5, b"ab" * 10: -2.0}
    lattice = scoring.Lattice(list(vocabulary), np.array(list(vocabulary.values())))
    word = b" " + b"abba" * 9 + b"ab" * 20
    counts = lattice.expected([word])
    assert counts @ np.array([len(p) for p in vocabulary]) == pytest.approx(len(word))
    wide = scoring.Lattice(list(vocabulary), np.array(list(vocabulary.values())))
    wide.row_bytes = 1000
    assert np.allclose(counts, wide.expected([word])) and np.allclose(lattice.marginals([word] * 9), wide.marginals([word] * 9))
    pieces = scoring.read_vocabulary(scoring.LatticeSettings(vocabulary=tokenizer_file("byte_bpe_50k.tiktoken")))
    assert max(map(len, pieces)) == 128


def test_scores_are_a_distribution(spark):
    """All words over two letters up to a length, and the end, weigh at most 1."""
    s = scoring.LatticeSettings(vocabulary=tokenizer_file("byte_bpe_50k.tiktoken"), rounds=1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b ab", "ba ba b", "abab a", "bbb"] * 4)], "doc_id long, text string")
    scored = {r.doc_id: r for r in scoring.score_documents(docs, s).collect()}
    totals = scored[0].train_tokens
    assert totals > 0 and all(r.n_known <= r.n_tokens for r in scored.values())
    assert 10 ** scored[0].score < 10 ** (scored[0].score / scored[0].n_tokens)


def test_best_fit_against_search():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 65) for _ in range(400)]
    bins = packing.OpenSequences(64)
    placed, used = packing.best_fit(lengths, 64, 0, bins)
    room, n = {}, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room.values() if r >= lengths[i]]
        if fits:
            assert room[placed[i][0]] == min(fits)
        else:
            room[placed[i][0]] = 64
            n += 1
        assert placed[i][1] == 64 - room[placed[i][0]]
        room[placed[i][0]] -= lengths[i]
    assert n == used


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = pack_settings()
    encode = packing.encoder(s.vocabulary, s.pattern)
    for x in ["", "a", " lead", "it's we're 123 4 !?", "<|endoftext|>", "a \n b\t\tc  ", "né 漢字 🙂　x", "\x1c a\x1f b"]:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_posterior_looks():
    s = minhash.MinHashSettings()
    looks = minhash.least_matches(s)
    rng = np.random.default_rng(0)
    for j, most in ((0.8, 0.01), (0.3, 1.0)):
        right = rng.random((4000, s.size)) >= j
        alive = minhash.survivors(np.zeros((4000, s.size), bool), right, looks)
        lost = 1 - len(alive) / 4000
        assert lost <= most if j == 0.8 else lost > 0.99


def labelled(name, spark, sf, learn, score):
    from evidrill.llm.common import key_remainder

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    out = score(docs, learn(docs, labels)).where(key_remainder("doc_id", 5) == 0).join(labels, "doc_id").collect()
    return [(r.score, r[name]) for r in out if r[name] is not None]


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    for name, module, cut in (("toxic", toxicity, 0.5), ("quality", quality, 0.3)):
        pairs = labelled(name, spark, sf, module.learn, module.score_documents)
        assert np.mean([(s >= cut) == bool(y) for s, y in pairs]) > 0.9
