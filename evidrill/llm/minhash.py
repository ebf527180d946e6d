r"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set are one class. Classes that agree in a band of their signatures are candidates;
signature batches are compared one after the other, and a candidate is pruned as soon as its posterior probability
of reaching the threshold falls below the chosen miss probability. Survivors are verified on full shingle sets.

Groups are never expanded to all pairs. In each of a few rounds every class meets one other of its bands that is in
another component so far; links are verified and join components. Then only members of a band that are still in
different components meet, in blocks of bounded size. A block of signatures tells which of its members survive with
one another; these meet again with their full sets, are verified there, and the block gives out only the links that
hold its components together. No link between components is lost, and no pair is ever a row of its own.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case; shingles are told apart by 64-bit hashes. Defined results: a
null text or one without words has an empty set and links with nothing; a text with fewer words than a shingle is one
shingle; repeated texts are one class; rows with one doc_id share the component; a null doc_id is left out of links
and keeps a null component; an empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidrill.llm.common import discard, free_name, lower_words, map_arrow, materialize, sorted_groups, splitmix, utf8
from evidrill.llm.components import connected_components, partial_labels


@dataclass(frozen=True)
class MinHashSettings:
    shingle: int = 5
    threshold_percent: int = 80
    bands: int = 24
    rows: int = 5
    batch: int = 24  #: signature values compared between two looks at the posterior
    miss: float = 1e-3  #: posterior probability of the threshold below which a candidate is pruned
    star_rounds: int = 3  #: rounds of one pair a class before what is left is compared in blocks
    block: int = 1024  #: members of a band compared at once
    block_shingles: int = 1 << 20  #: and shingles of theirs
    seed: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the text's n-word shingles."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def _permutations(s: MinHashSettings) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(s.seed)
    a = draw.integers(1, 1 << 63, size=(s.size, 1), dtype=np.uint64) | np.uint64(1)
    return a, draw.integers(0, 1 << 63, size=(s.size, 1), dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least multiplied hash for each permutation, in pieces that stay in cache.

    Sixteen bits leave one chance agreement in 65,536 values, and halve what the joins carry.
    """
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 512):
        x = hashes[None, i : i + 512] * a
        x += b
        np.minimum(out, x.min(axis=1), out=out)
    return (splitmix(out) >> np.uint64(48)).astype(np.uint16)


def band_keys(signatures: np.ndarray, s: MinHashSettings) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), s.bands, s.rows)
    keys = np.broadcast_to(np.arange(s.bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(s.rows):
        keys = splitmix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def least_matches(s: MinHashSettings) -> list[tuple[int, int]]:
    """(compared, matches) at each look: with fewer matches the posterior of the threshold is below ``miss``.

    The prior is uniform, so after m of n matches the posterior is Beta(m+1, n-m+1), whose tail above t equals the
    chance of at most m successes in n+1 trials of t.
    """
    t, out = s.threshold_percent / 100, []
    for n in range(s.batch, s.size + 1, s.batch):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= s.miss:
                out.append((n, m))
                break
    return out


def survivors(left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two equally long signature tables are not pruned; each look compares the next batch only."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    done = 0
    for n, least in looks:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def sign_documents(docs: DataFrame, s: MinHashSettings) -> DataFrame:
    """(doc_id, n_shingles, class_key, signature); one pass over the whole texts."""

    def signer():
        a, b = _permutations(s)

        def work(batch: pa.RecordBatch):
            counts, keys, signed = [], [], []
            for t in utf8(batch.column(1)):
                h = shingle_hashes(t, s.shingle)
                counts.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                signed.append(signature(h, a, b).astype("<u2").tobytes() if len(h) else None)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], names=["doc_id", "n_shingles", "class_key", "signature"])

        return work

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), signer, "doc_id long, n_shingles long, class_key binary, signature binary")


def _bands(s: MinHashSettings):
    def make():
        def work(b: pa.RecordBatch):
            keys = band_keys(np.stack([np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()]), s)
            yield pa.record_batch([b.column(0), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), s.bands).cast(pa.list_(pa.int64()))], names=["rep", "n_shingles", "keys"])

        return work

    return make


def _fitting(left: np.ndarray, right: np.ndarray, s: MinHashSettings) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * np.minimum(left, right) >= s.threshold_percent * np.maximum(left, right)


def _prune(s: MinHashSettings):
    looks = least_matches(s)

    def make():
        def work(b: pa.RecordBatch):
            at = np.flatnonzero(_fitting(np.asarray(b.column("left_size")), np.asarray(b.column("right_size")), s))
            if not len(at):
                return
            left, right = (np.stack([np.frombuffer(x, "<u2") for x in b.column(c).take(pa.array(at)).to_pylist()]) for c in ("left", "right"))
            alive = pa.array(at[survivors(left, right, looks)])
            yield pa.record_batch([b.column("a").take(alive), b.column("b").take(alive)], names=["a", "b"])

        return work

    return make


_BLOCK = ("band", "low", "high", "mine", "rep", "component", "n_shingles", "signature")
_BLOCK_SCHEMA = "band long, low int, high int, mine int, rep long, component long, n_shingles long, signature binary"


class _Block:
    """Members of two of a band's blocks, or of one, and which of them survive with one another."""

    def __init__(self, g: pa.Table, s: MinHashSettings):
        self.s, self.rows = s, g
        self.band, self.low, self.high = (g.column(k)[0].as_py() for k in ("band", "low", "high"))
        self.rep, self.size = np.asarray(g.column("rep")), np.asarray(g.column("n_shingles"))
        self.label = np.unique(np.asarray(g.column("component")), return_inverse=True)[1]
        self.signed = np.stack([np.frombuffer(x, "<u2") for x in g.column("signature").to_pylist()])
        self.keys = band_keys(self.signed, s)
        mine = np.asarray(g.column("mine"))
        self.left = np.flatnonzero(mine == self.low)
        self.right = self.left if self.low == self.high else np.flatnonzero(mine == self.high)

    def survivors_of(self, i: int, looks: list[tuple[int, int]]) -> np.ndarray:
        """Members of other components that survive with member ``i`` and meet it in no band before this one."""
        right = self.right
        other = right[(self.label[right] != self.label[i]) & ((self.rep[right] > self.rep[i]) | (self.low != self.high)) & _fitting(self.size[right], self.size[i], self.s)]
        first = (self.keys[other] == self.keys[i]).argmax(axis=1)
        other = other[self.keys[i, first] == self.band]
        return other[survivors(np.broadcast_to(self.signed[i], (len(other), self.s.size)), self.signed[other], looks)]


def _surviving(s: MinHashSettings):
    """The members of each pair of blocks that survive with another one."""
    looks = least_matches(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["band", "low", "high"]):
            block, alive = _Block(g, s), np.zeros(g.num_rows, dtype=bool)
            for i in block.left.tolist():
                found = block.survivors_of(i, looks)
                alive[found] = True
                alive[i] |= len(found) > 0
            if alive.any():
                yield from g.filter(pa.array(alive)).to_batches()

    return run


def linked(own: np.ndarray, others: list[np.ndarray], s: MinHashSettings) -> np.ndarray:
    """Which of the sorted, non-empty sets ``others`` reach the threshold with the sorted set ``own``."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat(own[at] == flat, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
    return 100 * both >= s.threshold_percent * (len(own) + sizes - both)


def _verified(s: MinHashSettings):
    """Links, confirmed on full sets, that hold the components of each pair of blocks together."""
    looks = least_matches(s)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["band", "low", "high"]):
            block, links = _Block(g, s), []
            column = g.column("shingles").combine_chunks()
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
            sets = [flat[i:j] for i, j in zip(offsets, offsets[1:])]
            for i in block.left.tolist():
                other = block.survivors_of(i, looks)
                if not len(other):
                    continue
                for j in other[linked(sets[i], [sets[k] for k in other], s)].tolist():
                    if block.label[i] != block.label[j]:
                        block.label[block.label == block.label[j]] = block.label[i]
                        links.append((block.rep[i], block.rep[j]))
            if links:
                a, b = np.array(links).T
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run


def shingle_sets(docs: DataFrame, reps: DataFrame, s: MinHashSettings) -> DataFrame:
    """(id, shingles): the sorted full sets of the documents in ``reps(rep)``.

    Joined by shuffle at every size: the ids grow with the corpus.
    """

    def shingled():
        def work(batch: pa.RecordBatch):
            sets = [shingle_hashes(t, s.shingle).view(np.int64) for t in utf8(batch.column(1))]
            for x in sets:
                x.sort()
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

        return work

    wanted = reps.select(F.col("rep").alias("doc_id")).hint("merge")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return map_arrow(chosen, shingled, "id long, shingles array<long>")


def verify(pairs: DataFrame, sets: DataFrame, s: MinHashSettings) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets reach the threshold."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    reached = pairs.join(right, "b").join(left, "a").where(100 * both >= s.threshold_percent * (F.size("sa") + F.size("sb") - both))
    return reached.select("a", "b")


def _labelled(bands: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of bands (band, rep, n, parts) with their component so far; at first each is its own."""
    own = bands.select("band", "rep", "n", "parts")
    if labels is None:
        return own.withColumn("component", F.col("rep"))
    return own.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", "parts", F.coalesce("component", "rep").alias("component"))


def _stars(own: DataFrame, number: int) -> DataFrame:
    """One pair (a < b) at most for each member: with the member of another component that leads one of its bands.

    First the member that shares most places in bands leads: the text that near copies were made from stands closer to
    all of them than they do to each other, so one round joins what copies alone would not. Later leaders are drawn by
    a hash of their id and the round.
    """
    if number == 0:
        shared = own.groupBy("rep").agg((-F.sum("n")).alias("draw"))
        own = own.join(shared, "rep")
    else:
        own = own.withColumn("draw", F.xxhash64("rep", F.lit(number)))
    leaders = own.groupBy("band").agg(F.min(F.struct("draw", F.col("rep").alias("leader"), F.col("component").alias("led"))).alias("x"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band", "x.*")
    met = own.drop("draw", "parts").join(leaders, "band").where("component <> led").groupBy("rep").agg(F.min(F.struct("draw", "leader"))["leader"].alias("leader"))
    return met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _with_signatures(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    side = lambda key, name: signatures.select(F.col("rep").alias(key), F.col("n_shingles").alias(f"{name}_size"), F.col("signature").alias(name))
    return pairs.join(side("b", "right"), "b").join(side("a", "left"), "a")


def _rest(bands: DataFrame, labels: DataFrame | None, signatures: DataFrame, sets: DataFrame, s: MinHashSettings) -> DataFrame:
    """Links between members of a band that the star rounds left in different components."""
    own = _labelled(bands, labels)
    split = own.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("parts").alias("parts")).where("least <> most")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    met = own.drop("n", "parts").join(split.select("band", "parts"), "band").select("band", "rep", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("band", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep", "component")
    blocks = met.join(signatures, "rep").select(*_BLOCK).repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "rep")
    alive = materialize(blocks.mapInArrow(_surviving(s), _BLOCK_SCHEMA), "block-survivors")
    full = alive.join(sets.withColumnRenamed("id", "rep"), "rep").select(*_BLOCK, "shingles")
    grouped = full.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "rep")
    links = materialize(grouped.mapInArrow(_verified(s), "a long, b long"), "block-links")
    discard(alive)
    return links


def near_duplicates(docs: DataFrame, settings: MinHashSettings = MinHashSettings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    s = settings
    signed = materialize(sign_documents(docs, s), "signatures")
    usable = signed.where("class_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy("class_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("least")).select("class_key", F.col("least.doc_id").alias("rep"), "least.n_shingles", "least.signature"), "classes")
    members = map_arrow(classes.select("rep", "signature", "n_shingles"), _bands(s), "rep long, n_shingles long, keys array<long>").select("rep", "n_shingles", F.explode("keys").alias("band"))
    parts = F.ceil(F.greatest(F.count("*") / s.block, F.sum("n_shingles") / s.block_shingles)).cast("int")
    shared = members.groupBy("band").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1")
    bands = materialize(members.drop("n_shingles").join(shared, "band"), "bands")
    sets = materialize(shingle_sets(docs, bands.select("rep").distinct(), s), "shingle-sets")

    signatures = classes.select("rep", "n_shingles", "signature")
    links, labels, tables = None, None, []
    for number in range(s.star_rounds):
        stars = _stars(_labelled(bands, labels), number)
        candidates = materialize(map_arrow(_with_signatures(stars, signatures), _prune(s), "a long, b long"), "star-candidates")
        found = materialize(verify(candidates, sets, s), "star-links")
        tables.append(found)
        discard(candidates)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        discard(labels)
        labels = partial_labels(links)

    second = _rest(bands, labels, signatures, sets, s)
    components = connected_components(second if links is None else links.unionByName(second))
    discard(bands, sets, labels, second, *tables)

    each = classes.select("class_key", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left").select("class_key", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("signature").join(each, "class_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, settings: MinHashSettings = MinHashSettings()) -> DataFrame:
    """One row of ``docs`` for each group, with its own columns only; rows with a null doc_id all stay.

    Of several rows with the kept id the first in the order of a hash of all columns stays.
    """
    kept = near_duplicates(docs, settings).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept_id")).distinct()
    chosen = docs.join(kept.hint("merge"), docs["doc_id"].cast("long") == kept["__kept_id"], "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in docs.columns]))
    place = free_name(docs, "place")
    one = chosen.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + __N1__), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - __N1__, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT x.a, x.b FROM (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both FROM s l JOIN s r ON l.g = r.g AND l.doc_id <> r.doc_id GROUP BY ALL
  ) x JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b
  WHERE 100 * x.both >= 80 * (p.n + q.n - x.both)
), reach AS (
  SELECT doc_id AS a, doc_id AS c FROM d
  UNION
  SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.a WHERE reach.c < e.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def oracle_sql(shingle: int) -> str:
    return ORACLE_SQL.replace("__N1__", str(shingle - 1))
