"""Quality classifier: similarity-weighted votes of nearest neighbours in a latent-semantic space.

Labelled documents become vectors once (hashed byte trigrams and counts of words said three times running, log term frequency, inverse
document frequency, truncated singular vectors) and are broadcast; every document's cosines with all of them are
computed exactly, in blocks.

Defined results: a null or empty text has no direction and gets the share of label 1 among the learned labels, as
does everything when nothing was learned (then 0.5); null labels are not learned from, and of several labels of a
document the greatest counts; ties among neighbours go to the one learned first; repeated texts get equal scores.
Extra columns of the input are kept, but for one with the name of the score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidrill.llm.common import add_by_text, map_arrow, utf8
from evidrill.llm.toxicity import labelled_sample


@dataclass(frozen=True)
class QualitySettings:
    trigram_dims: int = 4096
    rank: int = 48
    neighbours: int = 15
    train_rows: int = 4096  #: labelled documents at most: bounds the fit and the broadcast (rank floats each)
    block_docs: int = 128
    oversample: int = 16
    power_steps: int = 3

    @property
    def dims(self) -> int:
        return self.trigram_dims + 1


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def term_counts(text: bytes, dims: int) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text, then of words that equal the two words before them."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(dims, dtype=np.float32)
    if len(b) >= 3:
        tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        tri = ((tri * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(dims - 1)
        out[:-1] = np.bincount(tri, minlength=dims - 1)
    words = text.split()
    out[-1] = sum(a == b == c for a, b, c in zip(words, words[1:], words[2:]))
    return out


def _packed(counts: np.ndarray) -> bytes:
    """The places and values of the counts that are not 0."""
    at = np.flatnonzero(counts)
    return np.stack((at, counts[at])).astype("<u4").tobytes()


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_quality(counts: np.ndarray, labels: np.ndarray, s: QualitySettings) -> QualityModel:
    """Latent-semantic basis by randomized subspace iteration, and the labelled documents' places in it."""
    n = len(counts)
    if not n:
        return QualityModel(np.ones(s.dims, np.float32), np.zeros((s.dims, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = (np.log((n + 1) / ((counts > 0).sum(0) + 1)) + 0.1).astype(np.float32)
    x = _weigh(counts, idf)
    k = min(s.rank + s.oversample, n, s.dims)
    q = np.random.default_rng(7).standard_normal((s.dims, k), dtype=np.float32)
    for _ in range(s.power_steps):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, values, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T)[:, : min(s.rank, k)].astype(np.float32)
    return QualityModel(idf, basis, _unit(x @ basis), labels.astype(np.float32), float(labels.mean()))


def vote(counts: np.ndarray, m: QualityModel, neighbours: int) -> np.ndarray:
    """Scores of a block: labels of the nearest labelled documents, weighted by cosine."""
    place = _weigh(counts, m.idf) @ m.basis
    out = np.full(len(counts), m.prior)
    if not len(m.vectors):
        return out
    cosine = _unit(place) @ m.vectors.T
    k = min(neighbours, cosine.shape[1])
    if k < cosine.shape[1]:
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        near = cosine >= least  # ties of the last place
        near &= (np.cumsum(near & (cosine == least), axis=1) <= k - (cosine > least).sum(1, keepdims=True)) | (cosine > least)
    else:
        near = np.ones_like(cosine, dtype=bool)
    weight = np.where(near, np.maximum(cosine, 0.0), 0.0).astype(np.float64)
    total = weight.sum(1)
    placed = (np.linalg.norm(place, axis=1) > 1e-9) & (total > 0)
    out[placed] = np.clip((weight @ m.labels)[placed] / total[placed], 0.0, 1.0)
    return out


def _train(s: QualitySettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(0).to_pylist())
        rows.sort()
        counts = np.zeros((len(rows), s.dims), dtype=np.float32)
        for i, r in enumerate(rows):
            at, own = np.frombuffer(r[2], dtype="<u4").reshape(2, -1)
            counts[i, at] = own
        labels = np.array([r[1] for r in rows], dtype=np.float32)
        del rows
        m = fit_quality(counts, labels, s)
        f = [np.ascontiguousarray(x, dtype="<f4").tobytes() for x in (m.idf, m.basis, m.vectors, m.labels)]
        yield pa.record_batch([*(pa.array([x], pa.binary()) for x in f), pa.array([m.prior])], names=["idf", "basis", "vectors", "labels", "prior"])

    return run


def learn(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings(), label: str = "quality", modulus: int | None = 5) -> QualityModel:
    """Count terms of the bounded sample in parallel, decompose in one task."""
    s = settings
    sample = labelled_sample(docs, labels, label, modulus, s.train_rows)

    def counted():
        def work(b: pa.RecordBatch):
            f = [_packed(term_counts(t, s.dims)) for t in utf8(b.column(0))]
            yield pa.record_batch([pa.array(f, pa.binary()), b.column(1), b.column(2)], names=["counts", "label", "place"])

        return work

    rows = map_arrow(sample, counted, "counts binary, label int, place long")
    r = rows.repartition(1).mapInArrow(_train(s), "idf binary, basis binary, vectors binary, labels binary, prior double").first()
    idf, basis, vectors, own = (np.frombuffer(r[x], "<f4") for x in ("idf", "basis", "vectors", "labels"))
    basis = basis.reshape(len(idf), -1)
    return QualityModel(idf, basis, vectors.reshape(len(own), basis.shape[1]), own, r.prior)


def score_documents(docs: DataFrame, model: QualityModel, settings: QualitySettings = QualitySettings(), column: str = "score") -> DataFrame:
    """``docs`` with the neighbours' vote for each whole text; exact cosines in blocks of ``block_docs`` documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    s = settings

    def scorer():
        m = shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            texts = utf8(column)
            blocks = (texts[i : i + s.block_docs] for i in range(0, len(texts), s.block_docs))
            return [pa.array(np.concatenate([vote(np.stack([term_counts(t, s.dims) for t in b]), m, s.neighbours) for b in blocks]))]

        return work

    return add_by_text(docs, {column: "double"}, scorer)
