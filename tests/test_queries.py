"""Every registered query agrees with its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
LLM = entry.llm.QUERIES if entry.llm else {}  # tested in tests/llm
QUERIES, ORACLE = ({k: v for k, v in d.items() if k not in LLM} for d in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(canonical(row[i]) for i in order)) for row in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
