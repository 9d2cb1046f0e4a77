"""Queries against their SQL, on whole tables."""

import duckdb
import pytest

from pairforge.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_match_sql(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    out = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(out.fetchall())
