"""Curation of an evaluation set: leakage, near-duplicates, independence, selection, split, two-pass annotation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.text import char_ngrams
from evidrill.operators.retrieval import numbered
from evidrill.sources.scratch import discard, write_once

#: Gram sets that meet as a block, bands of sizes within a factor of the threshold, and bits of the shortest signature.
SET_BLOCK, BANDS, LEAST_BITS = 8192, 4, 256
#: From this threshold on, signatures tell apart most sets that are unlike; below it their bound says nothing.
SIGNED_FROM = 0.5


def seeded_order(seed: str, key: str | Column) -> Column:
    """A reproducible shuffle: the digest of the seed and the key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat_ws("|", F.lit(seed), k.cast("string")), 256)


def grams_of(df: DataFrame, key: str, text: str | Column, n: int = 3) -> DataFrame:
    t = F.col(text) if isinstance(text, str) else text
    return df.select(F.col(key).alias("id"), t.alias("text"), char_ngrams(t, n).alias("grams")).withColumn("size", F.size("grams"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, self_join: bool = False, n: int = 3) -> DataFrame:
    """(left_id, right_id, similarity): all pairs of gram sets at or above a Jaccard threshold, exactly.

    Candidates come from signatures, or below ``SIGNED_FROM`` from prefixes, and are compared as full sets. Inputs are
    ``grams_of`` tables of the same ``n``; empty sets pair with nothing. Copies of a set make a pair each: ``similar_texts``
    compares them once. Texts are written and joined, many times smaller than their sets, which are made again of pairs.
    """
    signed = threshold >= SIGNED_FROM

    def written(df: DataFrame) -> DataFrame:
        return grams_of(write_once(df.select("id", "text"), "gram-texts"), "id", "text", n) if signed else write_once(df, "gram-sets")

    left = written(left)
    right = left if self_join else written(right)
    pairs = (_by_signatures if signed else _by_prefixes)(left, right, threshold, self_join)
    texts = pairs.join(left.select(F.col("id").alias("left_id"), F.col("text").alias("lt")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("text").alias("rt")), "right_id")
    full = texts.select("left_id", "right_id", char_ngrams("lt", n).alias("lg"), char_ngrams("rt", n).alias("rg"))
    shared = F.size(F.array_intersect("lg", "rg"))
    similarity = shared / (F.size("lg") + F.size("rg") - shared)
    return full.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _by_prefixes(left: DataFrame, right: DataFrame, threshold: float, self_join: bool) -> DataFrame:
    """Candidates (left_id, right_id) of written gram sets that share one of their rarest grams.

    With grams in one global order, rarest first, sets that reach the threshold share a gram among their first
    size - ceil(threshold * size) + 1. Only those grams are joined, and only pairs of fitting sizes whose places leave
    room for enough shared grams stay. Where all grams are frequent, this counts most pairs of sets.
    """
    def exploded(df: DataFrame, side: str) -> DataFrame:
        return df.where("size > 0").select(F.lit(side).alias("side"), "id", "size", F.explode("grams").alias("gram"))

    l = exploded(left, "l")
    both = l if self_join else l.unionByName(exploded(right, "r"))
    frequency = both.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = both.join(frequency, "gram").withColumn("place", F.row_number().over(Window.partitionBy("side", "id").orderBy("df", "gram")))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1)
    a = prefix.where("side = 'l'").select(F.col("id").alias("left_id"), F.col("size").alias("ls"), F.col("place").alias("lp"), "gram")
    b = (prefix if self_join else prefix.where("side = 'r'")).select(F.col("id").alias("right_id"), F.col("size").alias("rs"), F.col("place").alias("rp"), "gram")
    fits = (F.col("ls") >= F.lit(threshold) * F.col("rs") - 1e-9) & (F.col("rs") >= F.lit(threshold) * F.col("ls") - 1e-9)
    met = a.join(b, "gram").where(fits & ((F.col("left_id") < F.col("right_id")) if self_join else F.lit(True))).groupBy("left_id", "right_id", "ls", "rs").agg(F.count("*").alias("shared"), F.max("lp").alias("lp"), F.max("rp").alias("rp"))
    # up to the last shared gram of both prefixes nothing else is shared; behind it the shorter rest at most
    most = F.col("shared") + F.least(F.col("ls") - F.col("lp"), F.col("rs") - F.col("rp"))
    return met.where(most * F.lit(1 + threshold) >= F.lit(threshold) * (F.col("ls") + F.col("rs")) - 1e-9).select("left_id", "right_id")


def _bands_to_unit(threshold: float) -> float:
    """Bands of sizes for each unit of a size's logarithm: sizes that can reach the threshold are at most ``BANDS`` apart."""
    return (BANDS - 1e-6) / max(-math.log(threshold), 0.01)


def _signed(scale: float):
    """(id, size, band, bits): each hash value's parity over a set's grams; a band's signatures are equally long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("grams")
            coded = grams.flatten().dictionary_encode()
            hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
            sizes = grams.value_lengths().to_numpy().astype("i8")
            ends = np.cumsum(sizes)
            bands = np.floor(np.log(sizes) * scale).astype("i4")
            bits: list[bytes] = [b""] * len(sizes)
            for band in np.unique(bands):
                width = max(LEAST_BITS, 1 << math.ceil(math.log2(2 * math.exp((band + 1) / scale))))
                own = np.flatnonzero(bands == band)
                for at in np.array_split(own, math.ceil(len(own) * width / (1 << 22))):
                    mine = np.concatenate([hashes[ends[i] - sizes[i] : ends[i]] for i in at]) % np.uint64(width)
                    counts = np.bincount(np.repeat(np.arange(len(at)) * width, sizes[at]) + mine.astype("i8"), minlength=len(at) * width)
                    for i, own_bits in zip(at, np.packbits((counts & 1).astype("u1").reshape(len(at), width), axis=1, bitorder="little")):
                        bits[i] = own_bits.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), pa.array(bands), pa.array(bits, pa.binary())], names=["id", "size", "band", "bits"])

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All signatures of a band and shard as one row; both lie in one task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks().sort_by([("band", "ascending"), ("shard", "ascending")])
    band, shard = whole["band"].to_numpy(), whole["shard"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (np.diff(band) != 0) | (np.diff(shard) != 0)])
    for i, j in zip(starts, [*starts[1:], len(band)]):
        own = whole.slice(i, j - i)
        ids = own["id"].combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([band[i]]), pa.array([shard[i]]), ids, pa.array([own["size"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(own["bits"].to_pylist())], pa.binary())], names=["band", "shard", "ids", "sizes", "bits"])


def _alike(threshold: float, self_join: bool):
    """Pairs of two blocks whose signatures differ in no more places than sets at the threshold may differ in grams."""
    part = (1 - threshold) / (1 + threshold)
    rows = 16

    def words(bits: bytes, count: int) -> np.ndarray:
        return np.frombuffer(bits, "<u8").reshape(count, -1)

    def folded(x: np.ndarray, width: int) -> np.ndarray:
        while x.shape[1] > width:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                ids, other_ids = b.column("ids")[n].values, b.column("other_ids")[n].values
                sizes, other_sizes = (np.frombuffer(b.column(c)[n].as_py(), "<i8") for c in ("sizes", "other_sizes"))
                x, y = words(b.column("bits")[n].as_py(), len(sizes)), words(b.column("other_bits")[n].as_py(), len(other_sizes))
                width = min(x.shape[1], y.shape[1])
                x, y = folded(x, width), np.ascontiguousarray(folded(y, width).T)
                most = math.floor(part * (sizes.max() + other_sizes.max()) + 1e-9)
                for i in range(0, len(x), rows):
                    far = np.zeros((min(rows, len(x) - i), y.shape[1]), "u2" if width < 1024 else "u4")
                    for w in range(width):
                        far += np.bitwise_count(x[i : i + rows, w, None] ^ y[w])
                    p, q = np.nonzero(far <= most)
                    ls, rs = sizes[i + p], other_sizes[q]
                    fits = (far[p, q] <= part * (ls + rs) + 1e-9) & (ls >= threshold * rs - 1e-9) & (rs >= threshold * ls - 1e-9)
                    if self_join and b.column("same")[n].as_py():
                        fits &= i + p < q
                    if fits.any():
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + p[fits])), other_ids.take(pa.array(q[fits]))], names=["left_id", "right_id"])

    return run


def _by_signatures(left: DataFrame, right: DataFrame, threshold: float, self_join: bool) -> DataFrame:
    """Candidates (left_id, right_id) of gram sets, with their texts, by parity signatures.

    A gram that one set alone holds flips one bit, so two signatures differ in no more bits than their sets differ in
    grams. Signatures of like sizes lie in blocks; blocks whose sizes can reach the threshold meet once and give out
    only pairs that differ little enough, so pairs that are unlike are never written. No gram is joined.
    """
    scale = _bands_to_unit(threshold)

    def blocks(df: DataFrame) -> DataFrame:
        kind = df.schema["id"].dataType.simpleString()
        signed = write_once(df.where("length(text) > 0").select("id", "grams").mapInArrow(_signed(scale), f"id {kind}, size long, band int, bits binary"), "signatures")
        shards = signed.groupBy("band").agg(F.ceil(F.count("*") / SET_BLOCK).alias("shards"))
        dealt = signed.join(F.broadcast(shards), "band").select("id", "size", "band", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), "bits")
        out = write_once(dealt.repartition("band", "shard").mapInArrow(_blocked, f"band int, shard int, ids array<{kind}>, sizes binary, bits binary"), "signature-blocks")
        discard(signed)
        return out

    a = blocks(left)
    others = a if self_join else blocks(right)
    b = others.select(*[F.col(c).alias(f"other_{c}") for c in a.columns])
    own, other = F.struct("band", "shard"), F.struct("other_band", "other_shard")
    meet = (F.abs(F.col("band") - F.col("other_band")) <= BANDS) & ((own <= other) if self_join else F.lit(True))
    keys = a.select("band", "shard").join(b.select("other_band", "other_shard"), meet)
    met = keys.join(a, ["band", "shard"]).join(b, ["other_band", "other_shard"]).withColumn("same", own == other)
    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    found = met.select("ids", "sizes", "bits", "other_ids", "other_sizes", "other_bits", "same").mapInArrow(_alike(threshold, self_join), f"left_id {kinds[0]}, right_id {kinds[1]}")
    if self_join:
        found = found.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).where("left_id < right_id")
    out = write_once(found, "alike")
    discard(a, None if self_join else others)
    return out


def similar_texts(df: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """(left_id, right_id, similarity): all pairs of rows (id, norm) whose texts reach the threshold.

    Equal texts are compared once; their rows come in when the links of distinct texts are known.
    """
    rows = write_once(df.where("norm <> ''").select("id", "norm"), "texts")
    texts = rows.groupBy("norm").agg(F.min("id").alias("text_id"), F.count("*").alias("copies"))
    members = rows.join(texts, "norm").select("text_id", "id")
    grams = grams_of(texts, "text_id", "norm", n)
    links = similar_pairs(grams, grams, threshold, self_join=True, n=n).unionByName(texts.where("copies > 1").select(F.col("text_id").alias("left_id"), F.col("text_id").alias("right_id"), F.lit(1.0).alias("similarity")))
    side = lambda s, name: members.select(F.col("text_id").alias(f"{s}_id"), F.col("id").alias(name))
    full = links.join(side("left", "a"), "left_id").join(side("right", "b"), "right_id").where("left_id <> right_id OR a < b")
    return full.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "similarity")


def best_match(pairs: DataFrame) -> DataFrame:
    """The most similar partner of each left id; ties go to the smallest right id."""
    return pairs.groupBy("left_id").agg(F.max_by(F.struct("right_id", "similarity"), F.struct("similarity", (-F.col("right_id")).alias("r"))).alias("m")).select("left_id", "m.right_id", F.round("m.similarity", 6).alias("similarity"))


def leakage_reasons(candidates: DataFrame, reference: DataFrame, criteria: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Reasons, in the order of ``criteria`` (name, columns), for which a candidate repeats the reference set."""
    df = candidates
    for name, columns in criteria:
        keys = reference.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct().withColumn(f"_hit_{name}", F.lit(True))
        on = [df[c] == keys[f"_{c}"] for c in columns]
        df = df.join(keys, on, "left").drop(*[f"_{c}" for c in columns])
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_hit_{n}"), F.lit(n)) for n, _ in criteria]))
    return df.withColumn("reasons", reasons).drop(*[f"_hit_{n}" for n, _ in criteria])


def canonical_duplicates(df: DataFrame, key: str, norm: Column) -> DataFrame:
    """canonical_id: the least id among rows of equal normalised text; empty texts stand alone."""
    keyed = write_once(df.withColumn("_n", F.when(norm == "", F.concat(F.lit("\u0000"), F.col(key).cast("string"))).otherwise(norm)), "normalised")
    # counted before the rows of a large group of copies meet, and joined, where a hot key can be split
    copies = keyed.groupBy("_n").agg(F.min(key).alias("canonical_id"), F.count("*").alias("copies"))
    return keyed.join(copies, "_n").drop("_n")


def independence_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): least id reachable over undirected ``edges(a, b)``; nodes without edges are their own.

    Least labels spread over edges and labels of labels (so long chains halve), each round written to the shared
    checkpoint folder; it ends when nothing changes.
    """
    both = write_once(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = write_once(nodes.select("id", F.col("id").alias("component")), "components")
    before = None
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"))
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left")
        labels, last = write_once(jump.select("id", F.least("component", "up").alias("component")), "components"), labels
        discard(last)
        state = labels.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels
        before = state


Vector = tuple[int, ...]


def select_by_quota(components: Sequence[tuple[object, Vector, Vector]], target: Vector) -> list[object] | None:
    """Components whose count vectors add up to ``target`` exactly, with the greatest score vector.

    Dynamic programme over partial counts on the driver: its states are bounded by the product of target + 1, not by
    the data. Components come as (id, counts, score); of equal scores the first found stays. None if nothing fits.
    """
    zero = tuple(0 for _ in components[0][2]) if components else ()
    states: dict[Vector, tuple[Vector, tuple | None]] = {tuple(0 for _ in target): (zero, None)}
    for ident, counts, score in components:
        found = {}
        for at, (value, chain) in states.items():
            then = tuple(a + b for a, b in zip(at, counts))
            if any(a > b for a, b in zip(then, target)):
                continue
            better = tuple(a + b for a, b in zip(value, score))
            held = found.get(then) or states.get(then)
            if held is None or better > held[0]:
                found[then] = (better, (ident, chain))
        states |= found
    end = states.get(tuple(target))
    if end is None:
        return None
    out, chain = [], end[1]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def grouped_split(components: Sequence[tuple[object, Vector, int, int]], target: Vector, desired_two_pass: int) -> list[object] | None:
    """Whole components (id, decision counts, two_pass, pages) whose decisions add up to ``target`` exactly.

    Of all such choices the one whose two-pass rows are nearest to the desired number, then the one with most pages,
    then the one with fewest two-pass rows; of equals the first found. Dynamic programming over (decision counts,
    two-pass rows), so states are bounded by the target and not by the data.
    """
    best: dict[tuple[Vector, int], tuple[int, tuple | None]] = {(tuple(0 for _ in target), 0): (0, None)}
    for ident, counts, two, pages in components:
        grown = {}
        for (at, seconds), (covered, chain) in best.items():
            then = tuple(a + b for a, b in zip(at, counts))
            if all(a <= b for a, b in zip(then, target)):
                key = (then, seconds + two)
                held = grown.get(key) or best.get(key)
                if held is None or covered + pages > held[0]:
                    grown[key] = (covered + pages, (ident, chain))
        best |= grown
    ends = [(abs(two - desired_two_pass), -pages, two, chain) for (at, two), (pages, chain) in best.items() if at == tuple(target)]
    if not ends:
        return None
    out, chain = [], min(ends, key=lambda e: e[:3])[3]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def diverse_shortlist(df: DataFrame, group: str, limit: int = 5, order: Sequence[str] = ("rank",)) -> DataFrame:
    """Greedy picks per group in three passes: new page and new topic, then new page, then any; ``limit`` a group.

    Ids are distinct in a group; a null topic is never new. A fold over each group's sorted (page, topic, id) triples
    inside the JVM, without the rows that no pass can pick: with fewer than ``limit`` pages and topics taken, the first
    pass picks among the first ``limit`` pages of a topic and the first ``limit`` topics of a page, where fewer than
    2 ``limit``^2 rows that do not fit stand before its pick; the second among the first rows of the first ``limit``
    pages; the third among the first ``limit`` rows.
    """
    row = F.struct(*[F.col(o) for o in order], F.col("page_number").alias("p"), F.col("topic").alias("t"), F.col("id").alias("i"))
    all_rows = df.select(F.col(group).alias("g"), row.alias("row"))
    pairs = all_rows.groupBy("g", F.col("row.p").alias("p"), F.col("row.t").alias("t")).agg(F.min("row").alias("row"))
    pages = pairs.groupBy("g", "p").agg(F.min("row").alias("row"))

    def first(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).where(F.col("nth") <= n).drop("nth")

    topical = first(first(pairs.where("t IS NOT NULL"), ["g", "t"], limit), ["g", "p"], limit)
    kept = [first(x, ["g"], n).select("g", "row") for x, n in ((topical, 2 * limit**2), (pages, limit), (all_rows, limit))]
    groups = kept[0].unionByName(kept[1]).unionByName(kept[2]).groupBy(F.col("g").alias(group)).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    kind = groups.schema["rows"].dataType.simpleString()

    def pick(fits):
        def step(acc: Column, x: Column) -> Column:
            taken = F.exists(acc, lambda a: a["i"] == x["i"])
            return F.when((F.size(acc) < limit) & ~taken & fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc)

        return step

    new = lambda acc, x, f: ~F.exists(acc, lambda a: a[f].eqNullSafe(x[f]))
    one = F.aggregate("rows", F.array().cast(kind), pick(lambda acc, x: new(acc, x, "p") & new(acc, x, "t") & x["t"].isNotNull()))
    two = F.aggregate("rows", one, pick(lambda acc, x: new(acc, x, "p")))
    three = F.aggregate("rows", two, pick(lambda acc, x: F.lit(True)))
    return groups.select(group, F.posexplode(three).alias("n", "x")).select(group, (F.col("n") + 1).alias("pick"), F.col("x.i").alias("id"), F.col("x.p").alias("page_number"), F.col("x.t").alias("topic"))


def compare_passes(df: DataFrame, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Agreed and disagreeing fields of pass1_* and pass2_*: scalars by trimmed text, lists as sets."""
    norm = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))))
    differ = [F.when(norm(f"pass1_{s}") != norm(f"pass2_{s}"), F.lit(s)) for s in scalars] + [F.when(as_set(f"pass1_{x}") != as_set(f"pass2_{x}"), F.lit(x)) for x in lists]
    out = df.withColumn("disagreements", F.array_compact(F.array(*differ)))
    return out.withColumn("agreed", F.size("disagreements") == 0)


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of "a->b"."""
    return df.groupBy(F.concat_ws("->", F.coalesce(F.col(before).cast("string"), F.lit("")), F.coalesce(F.col(after).cast("string"), F.lit(""))).alias("transition")).agg(F.count("*").alias("n"))


def in_batches(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """batch: running number of batches of ``size`` rows in a total order."""
    return numbered(df, order).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int") + 1)


def in_sized_batches(df: DataFrame, order: Sequence[Column], sizes: Sequence[int]) -> DataFrame:
    """Batch: which of the given sizes a row falls in; rows beyond them all have none."""
    total = 0
    batch = F.lit(None).cast("int")
    bounds = []
    for i, s in enumerate(sizes, 1):
        total += s
        bounds.append((total, i))
    for bound, i in reversed(bounds):
        batch = F.when(F.col("place") <= bound, i).otherwise(batch)
    return numbered(df, order).withColumn("batch", batch)


def blind_queue(df: DataFrame, key: str, seed: str, fields: Sequence[str], prefix: str = "blind_") -> tuple[DataFrame, DataFrame]:
    """(queue with whitelisted fields under blinded ids, linkage of blinded to own ids)."""
    ident = F.concat(F.lit(prefix), F.substring(seeded_order(seed, key), 1, 20))
    named = df.withColumn("blind_id", ident)
    return named.select("blind_id", *fields), named.select("blind_id", key)


def overlay(gold: DataFrame, decisions: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Adjudicated values where there are any, the selection's own elsewhere; adjudicated tells which."""
    d = decisions.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields], F.lit(True).alias("adjudicated"))
    out = gold.join(d, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_d_{f}"), F.col(f)))
    return out.drop(*[f"_d_{f}" for f in fields]).na.fill(False, ["adjudicated"])


def cached_or_planned(plan: DataFrame, cache: DataFrame, key: str = "cache_key", most_tries: int | None = None) -> DataFrame:
    """Status of each planned call: cache_hit, failed (to be tried again), given_up (after ``most_tries``) or planned."""
    c = cache.groupBy(key).agg(F.bool_or(F.col("status") == "success").alias("_ok"), F.count("*").alias("_n"))
    tried = F.when(F.col("_n") >= most_tries, "given_up").otherwise("failed") if most_tries else F.lit("failed")
    return plan.join(c, key, "left").withColumn("status", F.when(F.col("_ok"), "cache_hit").when(F.col("_n") > 0, tried).otherwise("planned")).drop("_ok", "_n")


def method_plan(samples: DataFrame, methods: DataFrame, models: DataFrame) -> DataFrame:
    """Every sample with every method and model, and the key that names the call; methods and models are short lists."""
    grid = samples.crossJoin(F.broadcast(methods)).crossJoin(F.broadcast(models))
    return grid.withColumn("cache_key", F.sha2(F.concat_ws("|", "sample_id", "method_id", "model_id"), 256))


def bind_policies(rows: DataFrame, policies: DataFrame, document: Column) -> DataFrame:
    """Rows (id, policy_ids) with the texts of their rules joined by newlines, and whether all are found verbatim."""
    one = rows.select("id", document.alias("document"), F.posexplode_outer("policy_ids").alias("n", "policy_id"))
    joined = one.join(policies.select("policy_id", "policy_text"), "policy_id", "left")
    ok = F.coalesce(F.contains("document", "policy_text"), F.lit(False))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "policy_text"))), lambda x: x["policy_text"]), "\n")
    return joined.groupBy("id").agg(texts.alias("evidence"), F.bool_and(ok).alias("bound"))
