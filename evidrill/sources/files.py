"""Scans and sinks: JSON lines, JSON objects, CSV with list cells, manifests, caches, registries, immutable tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidrill.operators.contracts import ContractError, duplicate_keys, fingerprint, require_none


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; a byte-order mark and blank lines are skipped, a bad line stops the job."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("row.*")


def read_json_object(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one object each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """S3: All cells as text, but for columns of JSON lists; a byte-order mark is part of no name."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=True).csv(path)
    for c in lists:
        df = df.withColumn(c, F.from_json(c, "array<string>"))
    return df


def write_csv(df: DataFrame, path: str, columns: Sequence[str], lists: Sequence[str] = (), order: Sequence[str] = ()) -> bool:
    """One immutable file for spreadsheet readers: byte-order mark, fixed field order, lists as JSON cells.

    Meant for tables that people review. The file takes its name only when it is complete; if it is there with the same
    bytes nothing happens (False), other bytes are an error.
    """
    spark = df.sparkSession
    out = df.select(*[F.to_json(c).alias(c) if c in lists else F.col(c) for c in columns])
    out = out.withColumnRenamed(columns[0], "\ufeff" + columns[0])  # the mark is the file's first character
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, parts = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = out.orderBy(*[F.col(("\ufeff" if c == columns[0] else "") + c) for c in order]) if order else out
    rows.coalesce(1).write.options(header=True, quote='"', escape='"', quoteAll=False).csv(parts.toString())
    try:
        part = next(s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
        if fs.exists(target):
            both = [spark.read.format("binaryFile").load(p.toString()).select(F.sha2("content", 256)).first()[0] for p in (part, target)]
            if both[0] != both[1]:
                raise ContractError(f"{path} exists with other rows")
            return False
        return bool(fs.rename(part, target))
    finally:
        fs.delete(parts, True)


def read_env(spark: SparkSession, path: str) -> dict[str, str]:
    """NAME=value lines of a short settings file; comments and quotes around values go, the last of a name counts."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line.rlike(r"^(export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=")).select(F.regexp_extract(line, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$", 1).alias("k"), F.regexp_extract(line, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$", 2).alias("v"))
    return {r.k: r.v[1:-1] if len(r.v) > 1 and r.v[0] == r.v[-1] and r.v[0] in "\"'" else r.v for r in rows.collect()}


def ordered_export(df: DataFrame, key: str) -> DataFrame:
    """All rows in the order of their key; a key that is empty or comes twice is an error."""
    require_none(duplicate_keys(df, [key]), f"export by {key}")
    return df.orderBy(key)


def write_asset(df: DataFrame, path: str, vector: str = "embedding") -> DataFrame:
    """Vectors as an immutable table, beside it the manifest (count, dimension, digest, ready) that is returned."""
    write_once(df, path)
    manifest = asset_manifest(df.sparkSession.read.schema(df.schema).parquet(path), vector)
    write_once(manifest, f"{path}.manifest")
    return manifest


def load_asset(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """An asset whose count, dimension and digest are those of its manifest, and which is ready; else an error."""
    df, stated = spark.read.parquet(path), spark.read.parquet(f"{path}.manifest").first()
    found = asset_manifest(df, vector).first()
    if found != stated or not found.ready:
        raise ContractError(f"{path}: manifest {stated}, found {found}")
    return df


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "source_id") -> DataFrame:
    """A manifest whose ids are there and unique."""
    df = read_jsonl(spark, path, schema)
    require_none(duplicate_keys(df, [key]), f"manifest {path}")
    return df


def manifest_status(df: DataFrame, fetched: Column, head: Column) -> DataFrame:
    """Registered goes to downloaded if the bytes begin as a PDF does, to download_failed otherwise."""
    new = F.when(F.col("status") != "registered", F.col("status")).when(fetched & (head == "%PDF"), "downloaded").otherwise("download_failed")
    return df.withColumn("status", new)


def read_cache(spark: SparkSession, folder: str, schema: T.StructType | str, identity: dict[str, str]) -> DataFrame:
    """A folder of cached records, of one version identity only."""
    df = spark.read.schema(schema).option("multiLine", True).json(folder)
    for name, value in identity.items():
        df = df.where(F.col(name) == value)
    return df


def read_registry(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Rows of a text file whose lines match; one column for each group of the pattern."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i).alias(n) for i, n in enumerate(names, 1)])


def latest_run(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The greatest name with a prefix in a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((n for n in names if n.startswith(prefix)), default=None)


def write_once(df: DataFrame, path: str) -> bool:
    """Write an immutable table. If it is there with the same rows nothing happens (False); other rows are an error."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        if fingerprint(spark.read.parquet(path)).first() != fingerprint(df).first():
            raise ContractError(f"{path} exists with other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def upsert(stored: DataFrame, arrived: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the last by ``order`` winning for each key, arrivals over stored ones."""
    from evidrill.operators.retrieval import ranked

    both = stored.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)))
    return ranked(both, [key], [F.col("_new").desc(), F.col(order).desc()], 1, "_nth").drop("_new", "_nth")


def unseen_files(arrived: DataFrame, stored: DataFrame, keys: Sequence[str] = ("source_hash", "granularity")) -> DataFrame:
    """R2: Arrivals whose file is not yet stored at their granularity."""
    return arrived.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def where_equal(df: DataFrame, **fields) -> DataFrame:
    """Equality filters of a store query; they reach the Parquet scan as pushed filters."""
    for name, value in fields.items():
        df = df.where(F.col(name) == value)
    return df


def asset_manifest(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, dimension and digest of vectors; ready if they are there and all of one dimension."""
    text = F.sha2(F.array_join(F.transform(F.col(vector), lambda x: x.cast("string")), ","), 256)
    part = F.conv(F.substring(text, 1, 15), 16, 10).cast("decimal(38,0)")
    m = df.groupBy(*by).agg(F.count("*").alias("vectors"), F.min(F.size(vector)).alias("least_dim"), F.max(F.size(vector)).alias("dim"), F.sum(part).cast("string").alias("digest"))
    return m.withColumn("ready", (F.col("vectors") > 0) & (F.col("least_dim") == F.col("dim"))).drop("least_dim")


def table_to_markdown(rows: str | Column) -> Column:
    """An array of rows of cells as a Markdown table: cells on one line, rows as wide as the header; under two rows, ''."""
    r = F.col(rows) if isinstance(rows, str) else rows
    clean = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    width = F.size(F.get(r, F.lit(0)))
    fit = lambda row: F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: clean(F.get(row, i - 1)))
    line = lambda row: F.concat(F.lit("| "), F.array_join(fit(row), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1))), line)
    return F.when(F.coalesce(F.size(r), F.lit(0)) < 2, "").otherwise(F.concat_ws("\n", line(F.get(r, F.lit(0))), rule, F.array_join(body, "\n")))


def sanitize(x: str | Column) -> Column:
    """Page text without control characters and with at most one empty line in a row."""
    t = F.col(x) if isinstance(x, str) else x
    t = F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def html_text(x: str | Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, block ends become line ends."""
    t = F.col(x) if isinstance(x, str) else x
    t = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|tr)>|<br\s*/?>", "\n")
    return sanitize(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t]+", " "))


def text_blocks(pages: DataFrame, least_chars: int = 20) -> DataFrame:
    """The text track: sanitized pages of at least ``least_chars`` that do not open with a list of references."""
    from evidrill.functions.rules import REFERENCE_HEADING

    t = sanitize("content")
    return pages.withColumn("content", t).where((F.length("content") >= least_chars) & ~F.col("content").rlike(REFERENCE_HEADING)).withColumn("block_type", F.lit("text"))


def merge_tracks(text: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tracks with block_order: by page, text before tables, each in its own order."""
    from pyspark.sql import Window

    both = text.withColumn("_track", F.lit(0)).unionByName(tables.withColumn("_track", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("page_number", "_track", "seq")
    return both.withColumn("block_order", F.row_number().over(w)).drop("_track")


def inspect_sources(pages: DataFrame, sampled: int = 30) -> DataFrame:
    """Scan-heavy sources: of the first pages, under a fifth with text and at least four fifths with images."""
    s = pages.where(F.col("page_number") <= sampled)
    counts = s.groupBy("source_file").agg(F.count("*").alias("sampled_pages"), F.count_if("has_text").alias("text_pages"), F.count_if("has_image").alias("image_pages"))
    ratio = lambda c: F.col(c) / F.col("sampled_pages")
    return counts.withColumn("scan_heavy", (ratio("text_pages") < 0.2) & (ratio("image_pages") >= 0.8))
