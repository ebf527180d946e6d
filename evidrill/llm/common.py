"""Shared plumbing of the training-data operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents that one bucket of a co-grouped job is meant to hold, in bytes of text.
BUCKET_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


_own_folder: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="evidrill-"))
    return f"file://{_own_folder[0]}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    A Parquet table rather than ``checkpoint()``, which would compute the plan twice and store it uncompressed.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/evidrill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialized tables whose last reader is done."""
    for t in tables:
        if t is not None:
            _forget(t.sparkSession, t.scratch_path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``: the size of its files for a plain scan, and of no use for other plans."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, text_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of bounded size for so many bytes of text; as many as there are shuffle partitions at least."""
    return int(max(shuffle_partitions(spark), text_bytes // bucket_bytes + 1))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null counts as the empty text."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` with A-Z in lower case; bytes methods know ASCII only, which is what is asked."""
    return text.lower().split()


def slices(lengths: Iterable[int], limit: int) -> Iterator[slice]:
    """Runs of rows whose lengths add up to ``limit`` at most; a longer row is a run of its own."""
    start = total = 0
    end = -1
    for end, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(start, end)
            start, total = end, 0
        total += n
    if end >= start:
        yield slice(start, end + 1)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a worker built once for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def add_by_text(docs: DataFrame, added: dict[str, str], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``docs`` with columns (name: type) that a worker makes from the whole texts; columns of these names are replaced."""
    taken = {x.lower() for x in added}
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken])
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in added.items())).fields])

    def worker():
        of = make()
        return lambda b: [pa.record_batch([*b.columns, *of(b.column(at))], names=[*names, *added])]

    return map_arrow(docs, worker, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream of batches that is sorted by ``keys``; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(starts, starts[1:]):
            if end == begin:
                continue
            key = tuple(c[begin] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator, for 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
