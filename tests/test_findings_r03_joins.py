"""Findings F4 and F6 of round 3: what a join, its index and a patch shuffle."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.memory import Memory
from factloom.operators import maintain, relate
from factloom.plans.bloom import Likely
from factloom.sources import jsonl

JOIN = {"from": {"type": "a.S", "fields": ["k"]}, "to": {"type": "a.T", "fields": ["k"]}}
KEY = {"n": "integer"}


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def told(m):
    ends = {e: {r["id"]: int(r["i_n"]) for r in m.entity(e).df.collect()} for e in ("a.S", "a.T")}
    return sorted((ends["a.S"][r["source"]], ends["a.T"][r["target"]], r["active"], r["privacy"]) for r in m.relations[0].df.collect())


@pytest.fixture
def memory(spark):
    m = Memory(spark, "kept")
    jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": i, "k": [None, [], [f"k{i}"], [f"k{i}", f"k{i + 1}", f"k{i}"], ["none"]][i % 5]} for i in range(30)]), KEY)
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"n": i, "k": f"k{i}"} for i in range(20)]), KEY)
    m.reclassify("a.T", F.when(F.col("i_n") % 2 == 1, "private").otherwise("public"))
    return m


WANT = sorted((i, t, True, "private" if t % 2 else "public") for i in range(30) for t in ({2: [i], 3: [i, i + 1]}.get(i % 5, [])) if t < 20)
COUNTERS = {"created": len(WANT), "previously_active": 0, "previously_inactive": 0, "skipped_null_or_missing": 12, "skipped_unmatched": 10}


@pytest.mark.parametrize("kept", [False, True])
def test_edges_are_read_from_one_table_of_matches(memory, tmp_path, kept):
    """Before, whoever read a relation joined its edges with both ends again, and an index matched three times."""
    index = maintain.JoinIndex(memory, str(tmp_path), "j", "r", JOIN, 4)
    got = index.build() if kept else relate.materialize_join(memory, "j", "r", JOIN).first().asDict()
    assert (got, told(memory)) == (COUNTERS, WANT)
    assert "Join" not in plan(memory.relations[0].df) and "Aggregate" not in plan(memory.relations[0].df)
    again = relate.materialize_join(memory, "j", "r", JOIN).first().asDict()
    assert again == COUNTERS | {"created": 0, "previously_active": len(WANT)} and told(memory) == WANT


def test_an_index_built_again_keeps_inactive_edges(memory, tmp_path):
    index = maintain.JoinIndex(memory, str(tmp_path), "j", "r", JOIN, 4)
    index.build()
    memory.deactivate_relation("j", memory.relations[0].df["privacy"] == "private")
    n = sum(p == "private" for *_, p in WANT)
    assert index.build() == COUNTERS | {"created": 0, "previously_active": len(WANT) - n, "previously_inactive": n}
    assert told(memory) == [(s, t, p == "public", p) for s, t, _, p in WANT]
    assert index.refresh()["previously_inactive"] == n


def test_patches_deletions_and_lookups_shuffle_what_they_may_change(spark, memory, tmp_path, monkeypatch):
    """Before, a patch of one node, or a lookup of one key, shuffled the whole table."""
    monkeypatch.setattr(maintain, "FEW", 0)
    index = maintain.JoinIndex(memory, str(tmp_path), "j", "r", JOIN, 4)
    index.build()
    current, new = memory.entity("a.S").df, lines(spark, [{"n": 2}]).select("value")
    rows = jsonl._wide(jsonl.parsed(jsonl.read_lines(new)), [memory.entity("a.S").fields["n"]], F.lit(None).cast("array<string>").alias("_fields"))
    some, rest = Likely(rows, "c_n", rows=1).parted(current, "c_n")
    assert some.count() < 5 and some.count() + rest.count() == 30
    patched = jsonl._patched(current, rows, "a.S", memory.entity("a.S").fields, {"n"}, ["c_n"], "public", 1)
    assert patched.count() == 30 and plan(patched).count("Union") == 1
    jsonl.import_jsonl(memory, "a.S", lines(spark, [{"n": 2, "k": ["k7"]}, {"n": 99, "k": ["k8"]}]), KEY)
    memory.delete_nodes("a.T", memory.entity("a.T").df.filter("i_n = 3"))
    got = index.refresh()
    want = sorted([e for e in WANT if e[1] != 3] + [(2, 7, True, "private"), (99, 8, True, "public")])
    assert told(memory) == want and not got["rebuilt"] and got["created"] == 2
    gone = [s for s, t, *_ in WANT if t == 3]
    assert got["skipped_unmatched"] == COUNTERS["skipped_unmatched"] + sum(all(t == 3 for x, t, *_ in WANT if x == s) for s in gone)


def test_lines_whose_ids_share_a_hash_are_no_duplicates(spark, monkeypatch):
    monkeypatch.setattr(jsonl.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    m = Memory(spark, "same")
    assert jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": 1}, {"n": 2}]), KEY)["created"] == 2
    with pytest.raises(Exception, match="duplicate keys"):
        jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": 3}, {"n": 3}]), KEY)
