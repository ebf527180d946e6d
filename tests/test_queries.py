"""Registered queries run, and give what DuckDB gives for their SQL."""

from __future__ import annotations

import pytest

from evidrill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["trust_gate", "rrf_page_fusion", "method_summary", "path_route_quota", "graph_rerank", "near_dup_pairs", "leakage_join", "greedy_dedup", "coverage_audit", "trace_failures", "service_retrieve", "chunk_three_granularity", "diverse_shortlist", "judge_outputs", "revision_reaudit", "selection_audit", "relay_events", "user_sessions", "table_fingerprint"])
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted((tuple(same(r[i]) for i in order) for r in want.fetchall()), key=str)
    got = sorted((tuple(same(r[c]) for c in columns) for r in registry.queries()[name](spark, sf).collect()), key=str)
    assert got == expected


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() >= 0
