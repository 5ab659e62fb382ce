"""Queries that cover whole tables, against brute force on rows that a cut would miss."""

from collections import Counter

from factloom import queries


def test_duplicate_keys_of_every_order(spark, tmp_path):
    keys = [(o, k) for o in range(1, 31) for k in range(3)] + [(o, 1) for o in range(1, 31, 2)] + [(7, 1), (20, 2)]
    spark.createDataFrame([(o, k, 1.0) for o, k in keys], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(str(o), str(k), n) for (o, k), n in Counter(keys).items() if n > 1}
    assert {tuple(r) for r in queries.QUERIES["duplicate_keys"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "n").collect()} == want


def test_every_fact_is_explained(spark):
    d = "/root/testdata/sf0.001"
    facts = queries.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").collect()
    got = queries.QUERIES["explain_provenance"](spark, d).select("l_orderkey", "l_linenumber").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, facts))


def test_statistics_of_every_type_and_zero_denominators_of_every_customer(spark):
    d = "/root/testdata/sf0.001"
    m = queries.tpch(spark, d)
    got = {(r["entity_type"], r["field"]) for r in queries.QUERIES["ontology_statistics"](spark, d).collect()}
    assert got == {(e.name, f) for e in m.entities.values() for f in e.fields} and len({t for t, _ in got}) == 6
    rows = queries.QUERIES["v2_zero_denominator"](spark, d).collect()
    assert sum(r["high"] for r in rows) == queries.table(spark, d, "customer").count() and all(r["orders"] == 0 and r["share"] is None for r in rows)
