"""Every query with SQL gives the rows of its SQL; the others run."""

import math

import duckdb
import pytest

from pairforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, list):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_match_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, out.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
