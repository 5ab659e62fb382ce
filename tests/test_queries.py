"""Every query against its DuckDB SQL."""

import math

import duckdb
import pytest

from factloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(repr(norm(r[c])) for c in cols) for r in df.collect())
    r = duck.execute(queries.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(repr(norm(dict(zip(names, x))[c])) for c in cols) for x in r.fetchall())
