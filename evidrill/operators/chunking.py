"""Three-granularity chunking of blocks: sentences added greedily, overlapping by whole sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target and overlap of each granularity, in estimated tokens; fixed values.
GRANULARITIES = {128: (128, 32), 512: (512, 64), 1024: (1024, 128)}
_MARKS = re.compile(r"([。；;.!！?？\n])")


def sentences_of(text: str) -> list[str]:
    pieces = _MARKS.split(text)
    bodies, marks = pieces[::2], [*pieces[1::2], ""]
    return [s for s in ((body.strip() + mark).strip() for body, mark in zip(bodies, marks)) if s]


def spans(sizes: list[int], target: int, overlap: int, drop_suffixes: bool = False) -> Iterator[tuple[int, int]]:
    """[start, end) of each chunk over sentence sizes.

    After the last sentence the walk goes on inside the overlap, so shrinking suffix chunks follow; ``drop_suffixes``
    stops at the first chunk that reaches the end.
    """
    n, start = len(sizes), 0
    while start < n:
        end, total = start, 0
        while end < n and (end == start or total + sizes[end] <= target):
            total += sizes[end]
            end += 1
        yield start, end
        if drop_suffixes and end == n:
            return
        back, shared = end, 0
        while back > start and shared + sizes[back - 1] <= overlap:
            back -= 1
            shared += sizes[back]
        start = max(start + 1, back)


def chunk_blocks(blocks: DataFrame, drop_suffixes: bool = False) -> DataFrame:
    """(block_id, block_type, granularity, chunk_in_block, content, token_count) of ``blocks(block_id, block_type, content)``.

    Tables stay whole. A null or empty text has no chunk; ids need not be unique; extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, kind, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = text or ""
                if kind == "table":
                    rows += [(key, kind, g, 0, text, max(1, int(len(text) / 1.5))) for g in GRANULARITIES]
                    continue
                sentences = sentences_of(text)
                sizes = [max(1, int(len(s) / 1.5)) for s in sentences]
                for g, (target, overlap) in GRANULARITIES.items():
                    for i, (start, end) in enumerate(spans(sizes, target, overlap, drop_suffixes)):
                        rows.append((key, kind, g, i, "".join(sentences[start:end]), sum(sizes[start:end])))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            names = ("block_id", "block_type", "granularity", "chunk_in_block", "content", "token_count")
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    return blocks.select(F.col("block_id").cast("long"), "block_type", "content").mapInArrow(run, "block_id long, block_type string, granularity int, chunk_in_block int, content string, token_count int")


def number_chunks(chunks: DataFrame, by: list[str]) -> DataFrame:
    """chunk_index: global per granularity within a document, in block order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "granularity").orderBy("block_id", "chunk_in_block")
    return chunks.withColumn("chunk_index", F.row_number().over(w) - 1)
