"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Defined results: a null or empty text has no features and gets the intercept's probability; documents with the same
text get the same score; labels that are null are not learned from, and of several labels of a document the greatest
counts; without any usable label every document gets 0; with labels of one class only, that class's smoothed share.
Extra columns of the input are kept, but for one with the name of the score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import add_by_text, key_remainder, lower_words, map_arrow, splitmix, utf8

#: Salts that keep the kinds of features apart: one word, two neighbours, two words around one left out.
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class FtrlSettings:
    bits: int = 20  #: hashed features: 2 ** bits
    train_rows: int = 8192  #: labelled documents learned from at most; bounds the model's fit, not what is scored
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0


@dataclass(frozen=True)
class FtrlModel:
    """Compact weights: only what L1 left; the size is bounded by ``2 ** bits`` whatever the corpus."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, dtype=np.float64)
        w[self.index] = self.weight
        return w


def features(text: bytes, bits: int) -> np.ndarray:
    """Hashed features of a whole text, with repeats: words, bigrams and skip-grams over one word."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.int64)
    crc = zlib.crc32
    h = splitmix(np.fromiter((crc(w) for w in words), dtype=np.uint64, count=len(words)))
    one = h * _SALTS[0]
    two = (h[:-1] * _SALTS[1]) ^ (h[1:] + _SALTS[1])
    skip = (h[:-2] * _SALTS[2]) ^ (h[2:] + _SALTS[2])
    return (splitmix(np.concatenate((one, two, skip))) >> np.uint64(64 - bits)).astype(np.int64)


def fit_ftrl(examples: list[tuple[np.ndarray, int]], settings: FtrlSettings) -> FtrlModel:
    """Fit on (distinct feature indices, label) pairs, in the order given."""
    size = 1 << settings.bits
    z, n, bz, bn = np.zeros(size), np.zeros(size), 0.0, 0.0
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * l1 - zi) / ((b + np.sqrt(ni)) / a + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    for _ in range(settings.epochs):
        for index, label in examples:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            bw = -bz / ((b + np.sqrt(bn)) / a)
            g = _sigmoid(w.sum() + bw) - label
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / a * w
            n[index] = ni + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / a * bw
            bn += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return FtrlModel(settings.bits, float(-bz / ((b + np.sqrt(bn)) / a)), kept, w[kept])


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int | None, rows: int) -> DataFrame:
    """(text, label, place) of at most ``rows`` labelled documents, those first in the order of a hash of the id.

    With ``modulus``, ids whose remainder is 0 are held out. Only ids go through the bounded sort; texts are joined
    to the ids that it leaves. Of several rows with one id the least text is learned from.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if modulus:
        usable = usable.where(key_remainder("doc_id", modulus) != 0)
    place = F.xxhash64("doc_id").alias("place")
    own = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    first = own.select("doc_id", "label", place).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy("place", "doc_id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label", "place")).alias("r")).select("r.*")


def _train(settings: FtrlSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
        rows.sort(key=lambda r: (r[2], r[1], r[0]))
        found = [(np.frombuffer(f, dtype=np.int32).astype(np.int64), y) for f, y, _ in rows]
        labels = {y for _, y in found}
        if len(labels) < 2:  # nothing to tell apart
            share = 0.0 if not found else (sum(y for _, y in found) + 0.5) / (len(found) + 1)
            share = min(max(share, 1e-9), 1 - 1e-9)
            model = FtrlModel(settings.bits, float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0))
        else:
            model = fit_ftrl(found, settings)
        yield pa.record_batch([pa.array([model.bias]), pa.array([model.index.astype("<i4").tobytes()]), pa.array([model.weight.astype("<f8").tobytes()])], names=["bias", "index", "weight"])

    return run


def learn(docs: DataFrame, labels: DataFrame, settings: FtrlSettings = FtrlSettings(), label: str = "toxic", modulus: int | None = 5) -> FtrlModel:
    """Hash the sample's features in parallel, fit in one task over at most ``settings.train_rows`` of them."""
    sample = labelled_sample(docs, labels, label, modulus, settings.train_rows)
    bits = settings.bits

    def hashed():
        def work(b: pa.RecordBatch):
            f = [np.unique(features(t, bits)).astype("<i4").tobytes() for t in utf8(b.column(0))]
            yield pa.record_batch([pa.array(f, pa.binary()), b.column(1), b.column(2)], names=["features", "label", "place"])

        return work

    rows = map_arrow(sample, hashed, "features binary, label int, place long")
    row = rows.repartition(1).mapInArrow(_train(settings), "bias double, index binary, weight binary").first()
    return FtrlModel(bits, row.bias, np.frombuffer(row["index"], "<i4").astype(np.int64), np.frombuffer(row.weight, "<f8"))


def score_documents(docs: DataFrame, model: FtrlModel, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text; every feature counts once however often it occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        m = shared.value
        w, bits = m.dense(), m.bits

        def work(texts: pa.Array) -> list[pa.Array]:
            out = np.empty(len(texts))
            for i, t in enumerate(utf8(texts)):
                f = features(t, bits)
                out[i] = _sigmoid(w[np.unique(f[w[f] != 0])].sum() + m.bias)
            return [pa.array(out)]

        return work

    return add_by_text(docs, {column: "double"}, scorer)
