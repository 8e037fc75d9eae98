"""The registry: names match, and a sample of queries equals its SQL check."""

import pytest

import __spark_entry__ as entry
import check

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "prompt_content", "secret_findings", "pii_findings", "decide_block", "audit_ledger",
    "upstream_outages", "requests_by_model", "report_lines",
]


def test_registry():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries)
    unchecked = {q for q in set(queries) - set(checks) if q != "pipeline" and not q.startswith("op")}
    assert unchecked == {"token_counts", "decide_requests"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_check(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check._rows(df.columns, df.collect()) == check._rows(columns, cursor.fetchall())


def test_entry(spark):
    (row,) = entry.entry(spark).collect()
    assert row["total_requests"] == 200
