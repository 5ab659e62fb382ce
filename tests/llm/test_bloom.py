"""The filter before joins lets every held row through, few others, and nothing for an empty table."""

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm.bloom import likely  # noqa: E402


def test_likely_keeps_what_is_held(spark):
    rows = spark.range(-20_000, 20_000).selectExpr("id as doc_id", "'x' as text", "1 as word")
    held = spark.range(0, 40_000, 40).selectExpr("id - 20000 as doc_id", "2 as word")
    out = {r[0] for r in likely(rows, "doc_id", held, "doc_id").select("doc_id").collect()}
    want = {r[0] for r in held.select("doc_id").collect()}
    assert want <= out
    assert len(out - want) < 0.1 * 40_000


def test_likely_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    held = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert [tuple(r) for r in likely(rows, "doc_id", held, "doc_id").filter("doc_id = 1").collect()] == [(1, "a"), (1, "a")]
    assert likely(rows, "doc_id", held.limit(0), "doc_id").count() == 0
    assert likely(rows.limit(0), "doc_id", held, "doc_id").count() == 0
    null = spark.createDataFrame([(None,)], "doc_id long")
    assert (None, "b") in [tuple(r) for r in likely(rows, "doc_id", null, "doc_id").collect()]
