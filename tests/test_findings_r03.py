"""Findings of round 3, on rows and plans that failed before."""

from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from factloom import queries
from factloom.memory import Memory
from factloom.operators import index
from factloom.sources import fragments, jsonl

SF = "/root/testdata/sf0.001"


def test_balances_that_round_to_negative_zero_or_are_null(spark, tmp_path):
    balances = [-0.001, -0.0, 0.0, 0.001, -0.004, -0.005, None, 2.5, -12.345]
    rows = [(3 * i + 1, f"n{i}", 1, b, "BUILDING") for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = duck.execute(queries.SQL["write_attribute_number"]).fetchall()
    got = queries.QUERIES["write_attribute_number"](spark, str(tmp_path)).select("whole", "score", "n").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and (0, "-0.0", 3) in want


def test_views_of_objects_leave_the_worker_in_small_pieces():
    """Before, the records of a whole batch were in memory together."""
    content = [b'{"id":1}\n' * n for n in (20_000, 200_000, 50_000, 0, 70_000, 60_000)] + [None]
    columns = [pd.Series(x) for x in (content, ["record_key"] * 7, ["jsonl"] * 7, [None] * 7, ["id"] * 7)]
    pieces = list(fragments._view.func(iter([columns])))
    assert [len(p) for p in pieces] == [1, 1, 2, 1, 2]
    assert [len(r) if r is not None else None for p in pieces for r in p["records"]] == [20_000, 200_000, 50_000, 0, 70_000, 60_000, None]


def test_lines_of_one_split_are_parsed_by_several_tasks(spark, monkeypatch):
    """Before, the parsed lines lay in as few partitions as their source had splits."""
    monkeypatch.setattr(jsonl, "TASK_LINES", 100)
    lines = jsonl.read_lines(spark.range(0, 350, 1, 1).select(F.to_json(F.struct("id")).alias("value")))
    dealt = jsonl.dealt(lines, 350).cache()
    per = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 4 and sum(per) == 350 and max(per) < 175
    m = Memory(spark, "dealt")
    assert jsonl.import_jsonl(m, "a.B", lines, {"id": "integer"})["created"] == 350
    assert {int(r["i_id"]) for r in m.entity("a.B").df.collect()} == set(range(350))


def test_duplicate_keys_of_lines_without_a_part_of_the_key(spark):
    lines = ['{"a":1,"b":2}', '{"a":1,"b":2.0}', '{"b":2,"a":1}', '{"a":1}', '{"c":0,"a":1}', '{"c":0}', '{"c":0}', "{", "["]
    rows = jsonl.parsed(jsonl.read_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert {tuple(r) for r in jsonl.duplicate_keys(rows, ["a", "b"]).collect()} == {("1", "2", 2), ("1", None, 2)}
    plan = jsonl.duplicate_keys(rows, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # before, one by line and one by key


def test_an_index_deals_its_texts_by_their_bytes(spark, monkeypatch, tmp_path):
    """Before, a task took a core's share of the texts, or a split, and sorted all its postings."""
    monkeypatch.setattr(index, "TASK_BYTES", 200)
    texts = [(i % 19, f"w{i} the The of" * 10) for i in range(20)] + [(30, None), (31, ""), (None, "the of")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    made = index.TextIndex.build(docs, ["doc_id"], str(tmp_path / "index"))
    files = list((tmp_path / "index" / "segment-0").glob("*.parquet"))
    assert len(files) > spark.sparkContext.defaultParallelism
    want = Counter((k, w, n) for k, t in texts if t for w, n in Counter(t.lower().split()).items())
    assert Counter(tuple(r) for r in made.postings().select("doc_id", "token", "tf").collect()) == want
    assert Counter(tuple(r) for r in made.documents().select("doc_id", "dl").collect()) == Counter((k, len(t.split())) for k, t in texts if t is not None)
    assert made.drift(docs).isEmpty()
