"""All queries of the engine, by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidrill.queries import anchors, curation, evaluation, graph, ingest, retrieval, reviews, streams

_FAMILIES = (retrieval, evaluation, graph, curation, anchors, reviews, ingest, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in _FAMILIES for name, (f, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
