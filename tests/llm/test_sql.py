"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(queries.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(dict(zip(names, x))[c] for c in cols) for x in r.fetchall())
    assert sorted(tuple(x[c] for c in cols) for x in df.collect()) == want
