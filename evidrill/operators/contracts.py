"""Contracts as data: every check is a plan that yields its violations; ``require_none`` turns rows into an error."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A contract is broken; the message shows a few of the violations."""


def require_none(violations: DataFrame, what: str) -> None:
    """Fail closed: at most five violations reach the driver."""
    rows = violations.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K2: Keys that are null, empty or repeated, with their number of rows."""
    bad = reduce(Column.__or__, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | bad)


def unequal_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only: missing (in the left only) or unexpected (in the right only)."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    missing = l.join(r, list(keys), "left_anti").withColumn("violation", F.lit("missing"))
    return missing.unionByName(r.join(l, list(keys), "left_anti").withColumn("violation", F.lit("unexpected")))


def equal_join(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Inner join of two tables that must hold the same unique keys."""
    for side, name in ((left, "left"), (right, "right")):
        require_none(duplicate_keys(side, keys), f"{what}: {name} keys")
    require_none(unequal_keys(left, right, keys), f"{what}: keys differ")
    return left.join(right, list(keys))


def drift(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose count differs from the expected one; a missing group counts 0."""
    a = actual.groupBy(*keys).agg(F.count("*").alias("actual"))
    both = a.join(expected.select(*keys, "expected"), list(keys), "full_outer").na.fill(0, ["actual", "expected"])
    return both.where("actual <> expected").withColumn("surplus", F.col("actual") - F.col("expected"))


def changed_fields(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """K4: Rows whose immutable fields changed, with the names of those that did."""
    l = before.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields])
    both = after.select(*keys, *fields).join(l, list(keys))
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]))
    return both.withColumn("changed", names).where(F.size("changed") > 0).select(*keys, F.array_join("changed", ",").alias("changed"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows, and the sum of row hashes over columns in the order of their names."""
    names = sorted(df.columns)
    text = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in names]), 256)
    part = F.conv(F.substring(text, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def same_table(first: DataFrame, second: DataFrame, what: str) -> None:
    """K7: Two runs of a plan must give the same rows."""
    a, b = fingerprint(first).first(), fingerprint(second).first()
    if a != b:
        raise ContractError(f"{what}: {a} and {b}")


#: Names that only gold data carries.
GOLD_NAMES = ("gold", "expected_decision", "anchor_text_span", "risk_labels", "page_number_gold", "fact_cluster_id")


def leaked_names(schema: T.DataType, names: Iterable[str] = GOLD_NAMES, path: str = "") -> list[str]:
    """Paths of fields, nested ones included, whose name is or holds a gold-only name."""
    out = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            here = f"{path}.{f.name}" if path else f.name
            if any(n in f.name.lower() for n in names):
                out.append(here)
            out += leaked_names(f.dataType, names, here)
    elif isinstance(schema, T.ArrayType):
        out += leaked_names(schema.elementType, names, f"{path}[]")
    elif isinstance(schema, T.MapType):
        out += leaked_names(schema.valueType, names, f"{path}{{}}")
    return out


def leaked_values(df: DataFrame, key: str, gold: DataFrame) -> DataFrame:
    """(key, field) of every text field that holds one of the gold texts in the only column of ``gold``.

    Texts meet by runs of their inner words, so the tables may be large; see ``holders``.
    """
    from evidrill.operators.evaluation import holders

    texts = gold.select(F.col(gold.columns[0]).alias("query")).distinct().withColumn("query_id", F.xxhash64("query"))
    fields = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    long = df.select(F.col(key).alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n), F.lit("")).alias("content")) for n in fields])).alias("x")).select("doc_id", "x.*")
    parts = [holders(long.where(F.col("field") == n), texts).select(F.col("doc_id").alias(key), F.lit(n).alias("field")) for n in fields]
    return reduce(DataFrame.unionByName, parts).distinct()


def project_runtime(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Exactly the allowed fields; gold names among them, or a field that is not there, are errors."""
    out = df.select(*allowed)
    if leaked := leaked_names(out.schema):
        raise ContractError(f"gold fields in a runtime projection: {leaked}")
    return out


def quarantine(df: DataFrame, checks: Sequence[tuple[str, Column]], ok: str = "pool") -> DataFrame:
    """The first failing check's name for each row, or ``ok``."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(checks)):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", F.coalesce(reason, F.lit(ok)))


def all_violations(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Names of all failing checks of each row."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])))


def compare_and_swap(df: DataFrame, keys: Sequence[str], field: str, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with ``edits(keys, expected_old, new_value)`` applied to one field, edits that do not apply).

    An edit applies to exactly one row whose value is the expected one, and must change it.
    """
    e = edits.select(*keys, "expected_old", "new_value")
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.first(field).alias("now"))
    state = e.join(counts, list(keys), "left")
    good = (F.col("n") == 1) & F.col("now").eqNullSafe(F.col("expected_old")) & ~F.col("new_value").eqNullSafe(F.col("now"))
    refused = state.where(~F.coalesce(good, F.lit(False))).select(*keys, "expected_old", "new_value", "now")
    kept = state.where(good).select(*keys, "new_value", F.lit(True).alias("_edit"))
    out = df.join(kept, list(keys), "left").withColumn(field, F.when(F.col("_edit"), F.col("new_value")).otherwise(F.col(field)))
    return out.select(*df.columns), refused
