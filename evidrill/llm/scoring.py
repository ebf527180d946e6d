r"""Language-model scores from a subword lattice: a text's probability is the sum over all its segmentations.

A word's lattice has an edge for each piece of an existing byte-level vocabulary that matches, and, if it is a training
word, one edge for the whole. Piece scores begin at the vocabulary's own order (a Zipf law over ranks) and are
re-estimated over the distinct training words by expectation-maximization; whole words weigh their discounted share of
the training tokens, and pieces share what the discounts leave. Forward recursion in log space sums over all
segmentations. Words begin with a space and no piece holds one elsewhere, so a document's lattice falls apart into
those of its words and the end: each distinct word is solved once. All single bytes are pieces, so every text has a
probability, and probabilities of all texts sum to 1 at most.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case. Beside the lattice stands the base: add-one word unigrams.

The counts of words never leave the executors; texts meet them in buckets of bounded size, each with its own distinct
words only. Only scores of pieces, bounded by the vocabulary, are broadcast.

Defined results: a null or empty text is the end token alone; repeated rows are scored alike; with no training
documents every count is 0 and the end has an even chance after each token; an empty table gives an empty result.
Extra columns are left out.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import bucket_count, key_remainder, lower_words, map_arrow, materialize, utf8

#: Distinct words held by a task before it passes them on.
HELD_WORDS = 300_000
_LN10 = log(10.0)


@dataclass(frozen=True)
class LatticeSettings:
    vocabulary: str  #: path of a byte-level vocabulary as ranks (one base64 piece and its rank a line)
    rounds: int = 2  #: of expectation-maximization
    rank_offset: float = 3.0
    smoothing: float = 0.05  #: added to each piece's expected count
    discount: float = 0.75  #: taken from each training word's count, for words by their pieces


def read_vocabulary(s: LatticeSettings) -> dict[bytes, int]:
    """Piece to rank: single bytes, and pieces without white space but for one leading space."""
    out = {}
    with open(s.vocabulary, "rb") as f:
        for a, b in map(bytes.split, f):
            piece = base64.b64decode(a)
            body = piece[1:] if piece[:1] == b" " else piece
            if len(piece) == 1 or body and body.split() == [body] and body == body.lower():
                out[piece] = int(b)
    for i in range(256):
        out.setdefault(bytes([i]), len(out) + i)
    return out


def initial_scores(vocabulary: dict[bytes, int], s: LatticeSettings) -> np.ndarray:
    """Log scores by rank, in the order of ``vocabulary``."""
    x = -np.log(np.array(list(vocabulary.values()), dtype=float) + s.rank_offset)
    return x - np.log(np.exp(x).sum())


def word_score(word: bytes, scores: dict[bytes, float], lengths: list[int]) -> float:
    """Natural log of the summed probability of all segmentations of ``word``; ``lengths`` of pieces, falling."""
    get, a = scores.get, [0.0]
    for j in range(1, len(word) + 1):
        terms = [a[j - n] + s for n in lengths if n <= j and (s := get(word[j - n : j])) is not None]
        top = max(terms)
        a.append(top + log(sum([exp(t - top) for t in terms])))
    return a[-1]


class Lattice:
    """Segmentations of many words at once: words of one length are the rows of a byte matrix.

    Pieces of up to ``short`` bytes are found by a 64-bit rolling hash in a table of slots with chains; all their hashes
    differ. Words beyond ``row_bytes`` bytes and words that hold a longer piece go one by one, by the same recursions.
    """

    row_bytes = 48
    short = 16
    rows = 4096
    slot_bits = 18
    _multiplier = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.size = len(pieces)
        self.lengths = sorted({len(p) for p in pieces}, reverse=True)
        self.by_piece = dict(zip(pieces, scores.tolist()))
        self.number = {p: i for i, p in enumerate(pieces)}
        self.long = [p for p in pieces if len(p) > self.short]
        own = np.array([len(p) <= self.short for p in pieces])
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(self.short):
                longer = np.array([len(p) > n for p in pieces]) & own
                hashes[longer] = self._next(hashes[longer], np.array([p[n] for p, x in zip(pieces, longer) if x], dtype=np.uint8))
        if len(np.unique(hashes[own])) < own.sum():
            raise ValueError("two pieces share a hash")
        none = len(pieces)  # stands for no piece
        self.scores, self.hashes = np.append(scores, -np.inf), np.append(hashes, np.uint64(0))
        self.first = np.full(1 << self.slot_bits, none, dtype=np.int32)
        self.chain = np.full(none + 1, none, dtype=np.int32)
        for i in np.flatnonzero(own).tolist():
            slot = int(hashes[i]) >> (64 - self.slot_bits)
            self.chain[i], self.first[slot] = self.first[slot], i

    def _next(self, h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return (h + byte + np.uint64(1)) * self._multiplier

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; the number of pieces stands for none."""
        at = self.first[h >> np.uint64(64 - self.slot_bits)]
        wrong = np.flatnonzero((self.hashes[at] != h) & (at != self.size))
        while len(wrong):
            at[wrong] = self.chain[at[wrong]]
            wrong = wrong[(self.hashes[at[wrong]] != h[wrong]) & (at[wrong] != self.size)]
        return at

    def _edges(self, m: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For each span of the rows of ``m``, places of pieces in ``scores``; the last place is no piece."""
        n, length = m.shape
        columns = [np.ascontiguousarray(m[:, j]) for j in range(length)]
        out = {}
        for i in range(length):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(length, i + self.short) + 1):
                h = self._next(h, columns[j - 1])
                if j - i in self.lengths:
                    out[i, j] = self._find(h)
        return out

    def _starts(self, j: int) -> list[int]:
        return [j - n for n in self.lengths if n <= min(j, self.short)]

    def _forward(self, m: np.ndarray, edges: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
        a = [np.zeros(len(m))]
        for j in range(1, m.shape[1] + 1):
            terms = np.stack([a[i] + self.scores[edges[i, j]] for i in self._starts(j)])
            top = terms.max(axis=0)
            a.append(top + np.log(np.exp(terms - top).sum(axis=0)))
        return a

    def _blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(places in ``words``, byte matrix); no matrix for words that go one by one."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for length in np.unique(sizes):
            at = np.flatnonzero(sizes == length)
            if length > self.row_bytes or len(at) < 8:
                yield at, None
                continue
            if length > self.short:
                alone = np.array([any(p in words[i] for p in self.long) for i in at])
                if alone.any():
                    yield at[alone], None
                    at = at[~alone]
            for k in range(0, len(at), self.rows):
                part = at[k : k + self.rows]
                yield part, np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8).reshape(len(part), length)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability: forward recursion over all segmentations."""
        out = np.empty(len(words))
        for at, m in self._blocks(words):
            out[at] = [word_score(words[i], self.by_piece, self.lengths) for i in at] if m is None else self._forward(m, self._edges(m))[-1]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over one occurrence of each word: forward and backward recursion."""
        out = np.zeros(self.size + 1)
        for at, m in self._blocks(words):
            if m is None:
                for i in at:
                    self._add_expected(words[i], out)
                continue
            edges = self._edges(m)
            a = self._forward(m, edges)
            back = [np.zeros(len(m)) for _ in a]
            back[-1] += 1.0
            used, shares = [], []
            for j in range(m.shape[1], 0, -1):
                for i in self._starts(j):
                    p = back[j] * np.exp(a[i] + self.scores[edges[i, j]] - a[j])
                    back[i] += p
                    used.append(edges[i, j])
                    shares.append(p)
            out += np.bincount(np.concatenate(used), np.concatenate(shares), minlength=len(out))
        return out[:-1]

    def _add_expected(self, word: bytes, out: np.ndarray) -> None:
        """Adds the expected uses over one word of any length; holds two numbers a byte."""
        score, a = self.by_piece, array("d", [0.0])
        for j in range(1, len(word) + 1):
            terms = [a[j - n] + s for n in self.lengths if n <= j and (s := score.get(word[j - n : j])) is not None]
            top = max(terms)
            a.append(top + log(sum([exp(t - top) for t in terms])))
        back = array("d", bytes(8 * len(word))) + array("d", [1.0])
        for j in range(len(word), 0, -1):
            for n in self.lengths:
                if n <= j and (s := score.get(piece := word[j - n : j])) is not None:
                    p = back[j] * exp(a[j - n] + s - a[j])
                    back[j - n] += p
                    out[self.number[piece]] += p


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of ``docs(text, learn)`` and its count in rows with ``learn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for text, learn in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                if learn:
                    held.update(lower_words(text))
                else:
                    for w in lower_words(text):
                        held.setdefault(w, 0)
                if len(held) >= HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    rows = docs.select("text", "learn").mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def fit_scores(words: DataFrame, s: LatticeSettings) -> Lattice:
    """Scores of the pieces from the distinct training words, each of which counts once: the lattice is for new words."""
    vocabulary = read_vocabulary(s)
    pieces = list(vocabulary)
    lattice = Lattice(pieces, initial_scores(vocabulary, s))
    for _ in range(s.rounds):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = sum([shared.value.expected([b" " + w for w in b.column(0).to_pylist()]) for b in batches if b.num_rows], np.zeros(len(pieces)))
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["piece", "expected"])

        rows = words.where("c > 0").select("word").mapInArrow(run, "piece long, expected double")
        # each piece's sum in a fixed order, so that results don't hang on the order of tasks
        summed = rows.groupBy("piece").agg(F.aggregate(F.sort_array(F.collect_list("expected")), F.lit(0.0), lambda a, x: a + x).alias("expected"))
        counts = np.full(len(pieces), s.smoothing)
        for r in summed.collect():  # no more rows than pieces
            counts[r.piece] += r.expected
        lattice = Lattice(pieces, np.log(counts / counts.sum()))
    return lattice


@dataclass(frozen=True)
class Totals:
    """Of the training tokens, ends included: their number, the distinct ones, and the documents."""

    tokens: int
    types: int
    documents: int

    def token_score(self, c: np.ndarray, lattice: np.ndarray, discount: float) -> np.ndarray:
        """log10 of a token's probability: its discounted share, and what the discounts leave spread by the lattice.

        A training word is one more edge of its own lattice, from its first byte to its last.
        """
        if not self.tokens:  # nothing seen: an even chance of the end
            return lattice / _LN10 + log10(0.5)
        left = lattice + log(discount * self.types / self.tokens)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(c - discount, 0.0) / self.tokens), left) / _LN10

    def end_score(self, discount: float) -> float:
        return log10((self.documents - discount) / self.tokens) if self.documents else log10(0.5)


def add_word_scores(words: DataFrame, lattice: Lattice, totals: Totals, discount: float) -> DataFrame:
    """(word, c, score): log10 of each distinct word's probability."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)

    def make():
        own = shared.value

        def work(b: pa.RecordBatch):
            marginal = own.marginals([b" " + w for w in b.column(0).to_pylist()])
            found = totals.token_score(np.asarray(b.column(1)), marginal, discount)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found)], names=["word", "c", "score"])

        return work

    return map_arrow(words.select("word", "c"), make, "word binary, c long, score double")


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each bucket in a stream of rows (doc_id, text, learn, bucket)."""
    held: dict[int, set[bytes]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for bucket, words in held.items():
            yield pa.record_batch([pa.array([bucket] * len(words), pa.int64()), pa.array(list(words), pa.binary())], names=["bucket", "word"])
        held.clear()

    for b in batches:
        for text, bucket in zip(utf8(b.column(1)), b.column(3).to_pylist()):
            held.setdefault(bucket, set()).update(lower_words(text))
        if sum(map(len, held.values())) >= HELD_WORDS:
            yield from passed_on()
    yield from passed_on()


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_bucket(totals: Totals, end: float):
    """Scores of a bucket's texts from the table of its words; every sum runs in the order of the text."""
    bottom = log10(totals.tokens + totals.types + 1)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        c, score = (words.column(k).to_numpy() for k in ("c", "score"))
        base, seen = np.log10(c + 1.0) - bottom, c > 0
        end_base, end_known = log10(totals.documents + 1) - bottom, int(totals.documents > 0)
        n, known, bases, scores = [], [], [], []
        for t in utf8(texts.column("text").combine_chunks()):
            at = np.array([place[w] for w in lower_words(t)], dtype=np.int64)
            n.append(len(at) + 1)
            known.append(int(np.count_nonzero(seen[at])) + end_known)
            bases.append(float(base[at].sum()) + end_base)
            scores.append(float(score[at].sum()) + end)
        held = pa.array([not x for x in texts.column("learn").to_pylist()], pa.bool_())
        columns = [texts.column("doc_id"), held, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([totals.tokens] * len(n), pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, settings: LatticeSettings, modulus: int = 7, held: int = 2) -> DataFrame:
    """Lattice and base scores of every whole text; learned from the rows whose id's remainder is not ``held``."""
    size = docs.select(F.count(F.when(key_remainder("doc_id", modulus) != held, 1)).alias("learn"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    buckets = bucket_count(docs.sparkSession, size.bytes)
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), (key_remainder("doc_id", modulus) != held).alias("learn"), bucket.alias("bucket"))
    words = materialize(count_words(rows), "words")
    documents = size.learn
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    totals = Totals(sums.n + documents, sums.v + (documents > 0), documents)
    lattice = fit_scores(words, settings)
    table = materialize(add_word_scores(words, lattice, totals, settings.discount), "word-scores")
    # the same exchange of the texts serves the search for each bucket's words and the scoring
    texts = rows.repartition(buckets, "bucket")
    known = texts.mapInArrow(_distinct_words, "bucket long, word binary").join(table, "word").select("bucket", "word", "c", "score")
    run = _score_bucket(totals, totals.end_score(settings.discount))
    return texts.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, _RESULT)
