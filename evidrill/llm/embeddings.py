"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact checks.

Equal vectors are one class. In each of ``tables`` hash tables a class stands in the buckets of its likeliest
``probes`` hash values; classes that meet in a bucket are compared in double precision. Buckets of any size are cut
into blocks, and every pair of blocks is one small matrix product, so no pair is written out: a bucket gives each class
the number of vectors that it links with (a pair counts in the first bucket that it meets in) and only the links
that hold its components together.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors are compared with those of their own length only. Repeated vec_ids are vectors of their own for links and share a row's component; an empty table gives
an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import map_arrow, materialize, sorted_groups, splitmix
from evidrill.llm.components import connected_components


@dataclass(frozen=True)
class CrossPolytopeSettings:
    threshold: float = 0.95
    tables: int = 8  #: at least; more where joined hashes make a table likelier to miss a pair
    missed: float = 3e-4  #: chance at most that a pair at the threshold meets in no table, whatever the number of hashes
    hashes: int = 0  #: cross-polytope hashes joined in one bucket key; 0: as many as the number of vectors asks for
    probes: int = 3  #: buckets of each table that a vector stands in
    rotations: int = 3  #: random sign flips, each followed by a Hadamard transform
    block: int = 2048  #: members of a bucket compared at once; of a large bucket each goes to as many tasks as it has blocks
    seed: int = 11

    @property
    def places(self) -> int:
        return self.tables * self.probes


def padded_size(dim: int) -> int:
    """Length of rotated vectors, a power of two; in shorter ones the signs leave too few different rotations."""
    return 1 << max(5, (dim - 1).bit_length())


def hashes_for(vectors: int, dim: int, s: CrossPolytopeSettings) -> int:
    """The least number of hashes, two at least, with four times more buckets a table than places taken in it.

    Strangers then meet by chance about as often at every size. A table finds fewer near pairs with each hash joined,
    so ``tables_for`` goes with it.
    """
    values, n = 2 * padded_size(dim), 2
    while values**n < 4 * vectors * s.probes:
        n += 1
    return n


@lru_cache(maxsize=None)
def tables_for(dim: int, s: CrossPolytopeSettings) -> int:
    """The least number of tables, ``s.tables`` at least, that miss a pair at the threshold with a chance of ``s.missed`` at most.

    Measured on random pairs of that length at exactly the threshold, the hardest ones: a pair that meets in k of n
    trial tables is missed by a share of C(n - k, t) / C(n, t) of all choices of t tables. Trials double until half of
    them are enough. Vectors of one component have only two directions.
    """
    if dim < 2:
        return s.tables
    draw = np.random.default_rng((s.seed, dim, 1))
    a, b = draw.standard_normal((2, min(2048, max(64, (1 << 17) // padded_size(dim))), dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = s.threshold * a + np.sqrt(1 - s.threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    trials = 2 * s.tables
    while True:
        x, y = (bucket_keys(v, replace(s, tables=trials)).reshape(len(v), trials, s.probes) for v in (a, b))
        apart = trials - (x[..., :, None] == y[..., None, :]).any(axis=(2, 3)).sum(axis=1)
        missed = np.ones(len(a))
        for t in range(1, trials // 2 + 1):
            missed *= np.maximum(apart - t + 1, 0) / (trials - t + 1)
            if t >= s.tables and missed.mean() <= s.missed:
                return t
        trials *= 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        a, b = y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]
        x = np.stack((a, b), axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(vectors: np.ndarray, s: CrossPolytopeSettings) -> np.ndarray:
    """Bucket keys, int64, of unit vectors: (rows, tables * probes); the same for any batch."""
    n, dim = vectors.shape
    size = padded_size(dim)
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    out = np.empty((n, s.tables, s.probes), dtype=np.int64)
    draw = np.random.default_rng((s.seed, dim))  # vectors of each length have rotations and buckets of their own
    for t in range(s.tables):
        values, scores = [], []
        for _ in range(s.hashes):
            x = padded
            for _ in range(s.rotations):
                x = hadamard(x * draw.choice((-1.0, 1.0), size))
            order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, : s.probes]
            top = np.take_along_axis(x, order, axis=1)
            values.append(2 * order + (top < 0))
            scores.append(np.abs(top))
        # a probe changes one hash at a time; the least loss of projection is the likeliest other bucket
        options = [tuple(0 for _ in range(s.hashes))]
        options += [tuple(r if i == j else 0 for i in range(s.hashes)) for j in range(s.hashes) for r in range(1, s.probes)]
        loss = np.stack([sum(scores[i][:, 0] - scores[i][:, r] for i, r in enumerate(o)) for o in options], axis=1)
        keys = np.stack([_key(t, dim, [values[i][:, r] for i, r in enumerate(o)]) for o in options], axis=1)
        first = np.argsort(loss, axis=1, kind="stable")[:, : s.probes]
        out[:, t, :] = np.sort(np.take_along_axis(keys, first, axis=1), axis=1)
    return out.reshape(n, -1)


def _key(table: int, dim: int, values: list[np.ndarray]) -> np.ndarray:
    k = np.full(len(values[0]), table * 1_000_003 + dim, dtype=np.uint64)
    for v in values:
        k = splitmix(k * np.uint64(0x100000001B3) + v.astype(np.uint64))
    return k.view(np.int64)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vector key) of all rows, and classes (rep, copies, embedding) of the usable ones."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)
    # a digest of the printed numbers stands for the vector; -0.0 prints as 0.0 after adding 0.0
    key = F.when(usable, F.sha2(F.array_join(F.transform(e, lambda x: (x + F.lit(0.0)).cast("string")), ","), 256))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"), e.alias("embedding"))
    same = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    return rows.select("vec_id", "key"), same


def _hash_rows(s: CrossPolytopeSettings):
    def make():
        def work(b: pa.RecordBatch):
            sizes = np.array([len(x) for x in b.column(2)])
            flat = np.asarray(b.column(2).flatten(), dtype=np.float64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = flat[starts[at][:, None] + np.arange(dim)]
                v /= np.abs(v).max(axis=1, keepdims=True)  # keeps squares in range
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                keys = bucket_keys(v, s)
                take = pa.array(at)
                yield pa.record_batch(
                    [
                        b.column(0).take(take),
                        b.column(1).take(take),
                        pa.array([x.tobytes() for x in v.astype("<f8")], pa.binary()),
                        pa.array([x.tobytes() for x in keys.astype("<i8")], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), keys.shape[1]).cast(pa.list_(pa.int64())),
                    ],
                    names=["rep", "copies", "vector", "places", "buckets"],
                )

        return work

    return make


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index into ``a``'s places at which rows of ``a`` and ``b`` share a bucket."""
    met = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return met.argmax(axis=1)


def _compare(s: CrossPolytopeSettings):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["bucket", "low", "high"]):
            bucket, low, high = (g.column(k)[0].as_py() for k in ("bucket", "low", "high"))
            mine = np.asarray(g.column("mine"))
            rep, copies = np.asarray(g.column("rep")), np.asarray(g.column("copies"))
            v = [np.frombuffer(x, "<f8") for x in g.column("vector").to_pylist()]
            places = np.stack([np.frombuffer(x, "<i8") for x in g.column("places").to_pylist()])
            left = np.flatnonzero(mine == low)
            right = left if low == high else np.flatnonzero(mine == high)
            if not len(left) or not len(right):
                continue
            links = np.zeros(len(rep), dtype=np.int64)
            sizes, pairs = np.array([len(x) for x in v]), []
            for dim in np.unique(sizes):  # more than one only where keys of two lengths collide
                p, q = left[sizes[left] == dim], right[sizes[right] == dim]
                if len(p) and len(q):
                    near = np.stack([v[k] for k in p]) @ np.stack([v[k] for k in q]).T >= s.threshold
                    if low == high:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    pairs.append((p[i], q[j]))
            i, j = (np.concatenate([x[k] for x in pairs] or [left[:0]]) for k in (0, 1))
            edges_a, edges_b = [], []
            step = max(1, (1 << 24) // places.shape[1] ** 2)
            for k in range(0, len(i), step):
                p, q = i[k : k + step], j[k : k + step]
                first = _first_meeting(places[p], places[q])
                here = places[p, first] == bucket
                p, q = p[here], q[here]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                edges_a.append(p)
                edges_b.append(q)
            if len(i):
                tree = _forest(len(rep), np.concatenate(edges_a), np.concatenate(edges_b))
                a, b = rep[tree[:, 0]], rep[tree[:, 1]]
                counted = np.flatnonzero(links)
                yield pa.record_batch([pa.array(np.concatenate((a, rep[counted]))), pa.array(np.concatenate((b, rep[counted]))), pa.array(np.concatenate((np.zeros(len(a), np.int64), links[counted])))], schema=schema)

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links of a spanning forest of the graph on n nodes, each as (node, its component's least place)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return np.stack((at, label[at]), axis=1)


def near_duplicates(vectors: DataFrame, settings: CrossPolytopeSettings = CrossPolytopeSettings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``."""
    s = settings
    rows, same = classes_of(vectors)
    classes = materialize(same, "vector-classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    s = replace(s, hashes=s.hashes or hashes_for(size.n, size.dim or 1, s))
    s = replace(s, tables=tables_for(size.dim or 1, s))
    hashed = materialize(map_arrow(classes.select("rep", "copies", "embedding"), _hash_rows(s), "rep long, copies long, vector binary, places binary, buckets array<long>"), "vector-hashes")
    members = hashed.select("rep", F.explode("buckets").alias("bucket"))
    blocks = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / s.block).cast("int").alias("parts"))
    # a class goes to its block's pairing with every block of the bucket, its own included
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    met = members.join(blocks, "bucket").select("bucket", "rep", own.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep")
    full = met.join(hashed.select("rep", "copies", "vector", "places"), "rep")
    grouped = full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rep")
    found = materialize(grouped.select("bucket", "low", "high", "mine", "rep", "copies", "vector", "places").mapInArrow(_compare(s), "a long, b long, links long"), "vector-links")
    components = connected_components(found.where("a <> b").select("a", "b"))
    linked = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("linked"))
    each = classes.select("key", "rep", "copies").join(linked, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(each, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
