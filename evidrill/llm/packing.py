"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are first cut into full windows, each a sequence of its own. What is left of each
document, in decreasing length, goes to the open sequence with the least room that suffices, found in a segment tree
over remaining capacities. Runs of documents are packed where they are read, so nothing is shuffled; open sequences
stay open from run to run of a partition.

Defined results: every document ends with token 0; a null or empty text is that token alone; rows with the same id
are separate documents; ties in length keep the order of reading. Extra columns of the input are left out.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import plan_bytes, slices

END_ID = 0
#: Sequence numbers that one partition may use.
PARTITION_SEQUENCES = 1 << 32
MOST_PARTITIONS = 1 << 20


@dataclass(frozen=True)
class PackSettings:
    vocabulary: str  #: path of a byte-level BPE vocabulary as ranks (one base64 piece and its rank a line)
    pattern: str  #: the vocabulary's splitting pattern
    window: int = 1024
    run_docs: int = 8192  #: documents sorted together
    run_tokens: int = 4 << 20  #: tokens of a run at most, unless one document is longer
    split_bytes: int = 64 << 20


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of a whole text as 32-bit words in native (little-endian) order; special tokens' strings are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: array("I", encode(text)).tobytes()


class OpenSequences:
    """Open sequences by remaining capacity; a segment tree holds how many there are of each."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.by_room: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i //= 2

    def put(self, sequence: int, room: int) -> None:
        if room:
            self.by_room[room].append(sequence)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``need``, and its room; removes it."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up, until something stands to the right
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.by_room[room].pop(), room


def best_fit(lengths: list[int], window: int, first: int, bins: OpenSequences) -> tuple[list[tuple[int, int]], int]:
    """(sequence, offset) of each length, packed in decreasing order; new sequences are numbered from ``first``."""
    placed = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = bins.take(lengths[i])
        if found is None:
            found, first = (first, window), first + 1
        sequence, room = found
        placed[i] = (sequence, window - room)
        bins.put(sequence, room - lengths[i])
    return placed, first


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(s: PackSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(s.vocabulary, s.pattern)
        following = TaskContext.get().partitionId() * PARTITION_SEQUENCES
        bins = OpenSequences(s.window)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            for r in slices([1] * b.num_rows, s.run_docs):
                part = b.slice(r.start, r.stop - r.start)
                ids = [encode(t or "") + end for t in part.column(1).to_pylist()]
                keys = part.column(0).to_pylist()
                for q in slices([len(x) // 4 for x in ids], s.run_tokens):
                    rows, tails = [], []
                    for key, own in zip(keys[q], ids[q]):
                        n = len(own) // 4
                        full = n - n % s.window
                        for start in range(0, full, s.window):
                            rows.append((key, start, s.window, own[4 * start : 4 * (start + s.window)], n, following, 0))
                            following += 1
                        if full < n:
                            tails.append((key, full, n - full, own[4 * full :], n))
                    placed, following = best_fit([t[2] for t in tails], s.window, following, bins)
                    rows += [(*t, *p) for t, p in zip(tails, placed)]
                    c = list(zip(*rows))
                    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, settings: PackSettings) -> DataFrame:
    """Pieces of documents with their token ids (little-endian 32-bit), sequence and place in it.

    Small partitions are joined up to ``split_bytes`` of input each, for fuller last sequences, as long as every core
    has some; none is split or shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = max(2 * docs.sparkSession.sparkContext.defaultParallelism, plan_bytes(docs) // settings.split_bytes)
    return rows.coalesce(int(min(wanted, MOST_PARTITIONS))).mapInArrow(_pack(settings), SCHEMA)
