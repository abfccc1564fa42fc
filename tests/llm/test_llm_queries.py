"""The registered queries against their SQL, or at least over the whole smallest tables."""

import duckdb
import pytest

from evalloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted({n for n in queries.QUERIES if n not in queries.ORACLE}))
def test_covers_every_document(spark, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = {r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()}
    assert got == ids if name != "pipeline" else got < ids
