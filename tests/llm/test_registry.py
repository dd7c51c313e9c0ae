"""The registered queries against their SQL on DuckDB, at the smallest size."""

import duckdb
import pytest

from docframe.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_covers_all_rows(spark, name):
    df = registry.queries()[name](spark, DATA)
    ids = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    got = df.select("doc_id").cache()
    assert got.exceptAll(ids).count() == 0 and ids.exceptAll(got).count() == 0
