"""Finding F6 of round 3: what a join with one key to a source, its index and a refresh shuffle."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factloom.memory import Memory
from factloom.operators import maintain, relate
from factloom.sources import jsonl

JOIN = {"from": {"type": "a.S", "fields": ["k"]}, "to": {"type": "a.T", "fields": ["k"]}}
KEY = {"n": "integer"}


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


@pytest.fixture
def memory(spark):
    m = Memory(spark, "kept")
    jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": i, "k": None if i % 5 == 0 else f"k{i % 12}"} for i in range(30)]), KEY)
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"n": i, "k": f"k{i}"} for i in range(10)]), KEY)
    m.reclassify("a.T", F.when(F.col("i_n") % 2 == 1, "private").otherwise("public"))
    return m


def told(m):
    ends = {e: {r["id"]: int(r["i_n"]) for r in m.entity(e).df.collect()} for e in ("a.S", "a.T")}
    return sorted((ends["a.S"][r["source"]], ends["a.T"][r["target"]], r["active"], r["privacy"]) for r in m.relations[0].df.collect())


def test_matches_of_one_key_stay_where_the_key_brought_them(memory):
    """Before, all sources with their targets were shuffled once more, by the source."""
    of = lambda: relate.met(memory, JOIN, True, {"b": F.lit(1)})
    rows = lambda df: sorted((r["id"], r["privacy"], r["keys"], r["matched"], r["hidden"], r["b"]) for r in df.collect())
    got = of()
    assert "Repartition" not in got._jdf.queryExecution().optimizedPlan().toString()
    memory.entities["a.S"] = replace(memory.entity("a.S"), unique=False)
    grouped = of()
    assert "Repartition" in grouped._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == rows(grouped) and got.dtypes == grouped.dtypes and got.count() == 30


def test_key_lists_are_the_tuples_of_key_rows(spark):
    m = Memory(spark, "lists")
    jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": 1, "a": ["x", "y", "x"], "f": 0.5}, {"n": 2, "a": [], "f": 1.0}, {"n": 3, "a": [None, "z"], "f": None}, {"n": 4, "a": ["x"], "f": -1.5}]), KEY)
    t = m.register_entity("a.D", spark.createDataFrame([(1, "x", -0.0), (2, "y", 0.0), (3, None, 1.5)], "i long, a string, f double"), "i", {"a": ("string", "a"), "f": ("double", "f")})
    s = m.entity("a.S")
    for e, fields, paired in ((s, ["a", "f"], [t.field("a"), s.field("f")]), (s, ["a"], [t.field("a")]), (t, ["f", "a"], [t.field("f"), t.field("a")])):
        rows = relate.key_rows(e, fields, paired, "x_")
        want = sorted((r["x_id"], r["key"]) for r in rows.select("x_id", relate.key_texts(rows, "x_").alias("key")).distinct().collect())
        lists = relate.key_lists(e, fields, paired)
        assert sorted((r["id"], k) for r in lists.collect() for k in r["keys"]) == want and lists.count() == e.df.count()
    assert [r["keys"] for r in relate.key_lists(t, ["f"], [t.field("f")]).orderBy("id").collect()] == [[["0.0"]], [["0.0"]], [["1.5"]]]


def test_new_nodes_may_have_an_id_again(memory, spark):
    assert memory.entity("a.S").unique
    jsonl.import_jsonl(memory, "a.S", lines(spark, [{"n": 2, "k": "k3"}]), KEY)
    assert memory.entity("a.S").unique
    jsonl.import_jsonl(memory, "a.S", lines(spark, [{"n": 99, "k": "k3"}]), KEY)
    assert not memory.entity("a.S").unique


@pytest.mark.parametrize("few", [0, maintain.FEW])
def test_a_refresh_of_one_key_equals_a_full_run(spark, memory, tmp_path, monkeypatch, few):
    """Before, ranges for the buckets of an index took a pass over all that was joined for them, and a shuffle."""

    def refused(*_):
        raise AssertionError("rows are shuffled for their bucket")

    monkeypatch.setattr(maintain, "FEW", few)
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", refused)
    index = maintain.JoinIndex(memory, str(tmp_path), "j", "r", JOIN, 4)
    index.build()
    memory.deactivate_relation("j", F.col("privacy") == "private")
    jsonl.import_jsonl(memory, "a.S", lines(spark, [{"n": 2, "k": "k7"}, {"n": 3, "k": None}, {"n": 99, "k": "k8"}]), KEY)
    jsonl.import_jsonl(memory, "a.T", lines(spark, [{"n": 4, "k": "k10"}, {"n": 50, "k": "k11"}]), KEY)
    memory.delete_nodes("a.T", memory.entity("a.T").df.filter("i_n = 6"))
    memory.delete_nodes("a.S", memory.entity("a.S").df.filter("i_n = 8"))
    full = Memory(spark, "full", entities=dict(memory.entities), relations=list(memory.relations))
    want = relate.materialize_join(full, "j", "r", JOIN).first().asDict()
    got = index.refresh()
    assert not got["rebuilt"] and {c: got[c] for c in want} == want and told(memory) == told(full) and want["created"] > 2
    assert index.refresh() == got | {"created": 0, "previously_active": got["previously_active"] + got["created"], "rematched": 0}
