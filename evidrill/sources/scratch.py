"""Tables written once to the shared folder: lineage is cut where a result is used twice or in rounds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a private folder only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="evidrill-"))
    return _own_folder[0]


def write_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back; the table goes when the interpreter exits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evidrill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables whose last reader is done."""
    for t in tables:
        if t is not None:
            _forget(t.sparkSession, t.scratch_path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        return
