"""Predicates, exact arithmetic, ingestion, joins, lifecycle, evidence and storage."""

import copy
import json
import random
import uuid
from collections import Counter
from datetime import datetime
from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.errors import FactloomError, ImportRejected, JoinError, QueryValidationError, StaleResultError
from factloom.functions import values
from factloom.memory import Memory
from factloom.operators import embeddings, index, lifecycle, maintain, observations, provenance, relate, retention, search, traverse, writes
from factloom.plans import aggregate, compile
from factloom.plans.ir import parse_v1, parse_v2
from factloom.sources import fragments, jsonl, store
from factloom.sources.versions import VersionStore


def lines(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "line long, value string")


# -- a plant: machines and the faults reported on them ------------------------------------------------------
MAKERS, SITES = ("Arno", "Bell", "Cori"), ("dock", "mill")
MACHINES = [{"serial": 700 + 3 * k, "maker": MAKERS[k % 3], "site": SITES[k * k % 5 % 2], "hours": 1000 + 37 * k} for k in range(20)]
CODES = ("leak", "noise", "heat", "dust")
FAULTS = [{"no": f"F{k}", "code": CODES[k * 7 % 4], "on": 700 + 3 * (k * k % 17)} for k in range(30)]
FAULTS += [{"no": "lost", "code": "leak", "on": 1}, {"no": "loose", "code": "heat"}, {"no": "void", "code": "noise", "on": None}]
GRAVE = ("leak", "heat")
JOIN = {"from": {"type": "plant.Fault", "fields": ["on"]}, "to": {"type": "plant.Machine", "fields": ["serial"]}}


@pytest.fixture
def plant(spark):
    m = Memory(spark, "plant")
    jsonl.import_jsonl(m, "plant.Machine", lines(spark, MACHINES), {"serial": "integer"})
    jsonl.import_jsonl(m, "plant.Fault", lines(spark, FAULTS), {"no": "string"})
    counters = relate.materialize_join(m, "fault_machine", "on", JOIN).first().asDict()
    assert counters == {"created": 30, "previously_active": 0, "previously_inactive": 0, "skipped_null_or_missing": 2, "skipped_unmatched": 1}
    return m


def where(field, op, *v):
    return {"left": {"field": field}, "op": op} | ({} if op == "exists" else {"right": {"values": list(v)} if op == "in" else {"value": v[0]}})


def query(**rest):
    edge = {"type": "on", "from": "f", "to": "m", "logical_key": "fault_machine"}
    return {
        "query_ir_version": "2", "match": {"nodes": [{"type": "plant.Machine", "as": "m"}]},
        "optional_match": [{"nodes": [{"type": "plant.Fault", "as": "f"}], "edges": [edge], "where": [where("f.code", "in", *GRAVE)]}],
        "measures": [
            {"as": "machines", "op": "count_distinct", "node": "m"}, {"as": "faults", "op": "count_distinct", "node": "f"}, {"as": "hit", "op": "count_distinct", "node": "m", "when": {"bound": "f"}},
            {"as": "hours", "op": "sum", "field": "m.hours", "distinct_on": "m", "when": {"bound": "f"}}, {"as": "each", "op": "sum", "field": "m.hours", "when": {"bound": "f"}},
        ],
        "derive": [{"as": "rate", "op": "ratio", "numerator": "hit", "denominator": "machines", "zero_denominator": "null"}],
    } | rest


def by_hand(machines, faults):
    """The measures of query() over these machines, by counting."""
    grave = [f for f in faults if f["code"] in GRAVE]
    on = {m["serial"]: [f["no"] for f in grave if f.get("on") == m["serial"]] for m in machines}
    hit = [m for m in machines if on[m["serial"]]]
    rate = (Decimal(len(hit)) / len(machines)).quantize(Decimal("1e-12"), ROUND_HALF_EVEN)
    return {"machines": len(machines), "faults": sum(map(len, on.values())), "hit": len(hit), "hours": sum(m["hours"] for m in hit), "each": sum(m["hours"] * len(on[m["serial"]]) for m in hit), "rate": f"{rate:f}"}


def test_totals_and_groups(plant):
    total = aggregate.run_v2(plant, parse_v2(query())).first().asDict()
    assert {k: total[k] for k in by_hand(MACHINES, FAULTS)} == by_hand(MACHINES, FAULTS)
    q = parse_v2(query(group_by=[{"field": "m.maker", "as": "maker"}, {"field": "m.site", "as": "site"}], order_by=[{"result": "rate", "direction": "desc"}, {"result": "maker"}, {"result": "site"}]))
    want = {}
    for maker in MAKERS:
        for site in SITES:
            mine = [m for m in MACHINES if (m["maker"], m["site"]) == (maker, site)]
            if mine:
                want[maker, site] = by_hand(mine, FAULTS)
    rows = aggregate.run_v2(plant, q).collect()
    assert [(r["maker"], r["site"]) for r in rows] == sorted(want, key=lambda k: (-Decimal(want[k]["rate"]), k))
    assert all({k: r[k] for k in want[r["maker"], r["site"]]} == want[r["maker"], r["site"]] for r in rows)
    assert aggregate.execute_v2(plant, q)["total_groups"] == len(want)
    maker, site = rows[0]["maker"], rows[0]["site"]
    key = {"maker": ("value", maker), "site": ("value", site)}
    ids = {r["node_id"] for r in aggregate.drill(plant, q, key, "counted_entities", "hit").collect()}
    serials = {int(r["i_serial"]) for r in plant.entity("plant.Machine").df.collect() if r["id"] in ids}
    grave = {f.get("on") for f in FAULTS if f["code"] in GRAVE}
    assert serials == {m["serial"] for m in MACHINES if (m["maker"], m["site"]) == (maker, site) and m["serial"] in grave}
    page = aggregate.drill_page(plant, q, key, "contributions", "hours", 0, 1)
    assert page["total_members"] == len(serials) and len(page["rows"]) == 1 and page["truncated"] == (len(serials) > 1)
    assert page["reconciliation"] == {"binding_count": want[maker, site]["faults"], "distinct_entities": len(serials), "sum_contributions": want[maker, site]["hours"]}
    assert aggregate.drill_page(plant, q, key, "contributions", "each")["reconciliation"]["sum_contributions"] == want[maker, site]["each"]
    with pytest.raises(QueryValidationError, match="no group"):
        aggregate.drill_page(plant, q, {"maker": ("value", "nobody"), "site": ("missing", None)}, "bindings")
    compact = aggregate.compact_drill(plant, "plant.Machine", aggregate.drill(plant, q, key, "counted_entities", "hit")).collect()
    assert {r["attributes"]["maker"] for r in compact} == {maker} and all(r["privacy"] == "public" for r in compact)
    kept = aggregate.membership(plant, q).filter("measure = 'hit'").collect()
    assert Counter((r["maker"], r["site"]) for r in kept) == Counter({k: v["hit"] for k, v in want.items() if v["hit"]})


def test_linked_inspection_correction(spark, plant):
    linked = {"query_ir_version": "1", "match": {"nodes": [{"type": "plant.Machine", "as": "m"}, {"type": "plant.Fault", "as": "f"}], "edges": [{"type": "on", "from": "f", "to": "m"}]}, "where": [where("f.code", "in", *GRAVE)], "return": [{"field": "m.serial"}, {"field": "f.no"}]}
    grave = [f for f in FAULTS if f["code"] in GRAVE]
    known = {m["serial"] for m in MACHINES}
    assert compile.run_v1(plant, parse_v1(linked)).count() == sum(f.get("on") in known for f in grave)
    p = parse_v1({"query_ir_version": "1", "match": {"nodes": [{"type": "plant.Fault", "as": "source"}]}, "where": [where("source.code", "in", *GRAVE)], "return": [{"count": True}]}).pattern.where
    reasons = {r["reason"]: r["n_sources"] for r in relate.reason_histogram(relate.inspect_relation(plant, "fault_machine", p)).collect()}
    assert reasons == Counter("missing_or_null_key" if f.get("on") is None else "linked" if f["on"] in known else "no_target" for f in grave)
    mended = [f | {"code": "heat"} if f["no"] == "F3" else f for f in FAULTS]
    assert mended != FAULTS
    jsonl.import_jsonl(plant, "plant.Fault", lines(spark, [{"no": "F3", "code": "heat"}]), {"no": "string"})
    assert aggregate.run_v2(plant, parse_v2(query())).first()["faults"] == by_hand(MACHINES, mended)["faults"]
    again = relate.materialize_join(plant, "fault_machine", "on", JOIN).first()
    assert (again["created"], again["previously_active"]) == (0, 30)
    with pytest.raises(JoinError):
        relate.materialize_join(plant, "fault_machine", "other", JOIN)
    relate.materialize_join(plant, "second", "on", JOIN)
    count = linked | {"return": [{"count": True}], "where": []}
    assert compile.run_v1(plant, parse_v1(count)).first()["count"] == 60


def test_unmatched_sources_count_once(spark):
    """A source is unmatched if none of its keys has a target."""
    m = Memory(spark)
    jsonl.import_jsonl(m, "x.From", lines(spark, [{"id": 1, "to": ["p", "gone"]}, {"id": 2, "to": ["gone", "lost"]}, {"id": 3, "to": []}, {"id": 4, "to": ["q", "p"]}]), {"id": "integer"})
    jsonl.import_jsonl(m, "x.To", lines(spark, [{"id": "p"}, {"id": "q"}]), {"id": "string"})
    got = relate.materialize_join(m, "j", "to", {"from": {"type": "x.From", "fields": ["to"]}, "to": {"type": "x.To", "fields": ["id"]}}).first()
    assert (got["created"], got["skipped_null_or_missing"], got["skipped_unmatched"]) == (3, 1, 1)


def test_numbers_beyond_a_decimal(spark):
    m = Memory(spark)
    jsonl.import_jsonl(m, "x.N", lines(spark, ['{"k": 1, "v": 1e300}', '{"k": 2, "v": 7}', '{"k": 3, "v": ' + "9" * 60 + "}"]), {"k": "integer"})
    got = {int(r["i_k"]): (r["v_v"], r["i_v"]) for r in m.entity("x.N").df.collect()}
    assert got == {1: (1e300, None), 2: (7.0, 7), 3: (1e60, None)}
    with pytest.raises(ImportRejected, match="out of range"):
        jsonl.import_jsonl(m, "x.N", lines(spark, ['{"k": 4, "v": ' + "9" * 400 + "}"]), {"k": "integer"})


def test_import_of_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"k": 1, "v": "a"}\r\n\n{"k": 2, "v": "b"}\n')
    m = Memory(spark)
    assert jsonl.import_file(m, "x.F", str(tmp_path / "a.jsonl"), {"k": "integer"})["created"] == 2
    assert jsonl.import_file(m, "x.F", str(tmp_path / "a.jsonl"), {"k": "integer"})["replayed"]
    store.save(m, str(tmp_path / "kept"))
    back = store.load(spark, str(tmp_path / "kept"))
    assert jsonl.import_file(back, "x.F", str(tmp_path / "a.jsonl"), {"k": "integer"})["replayed"]
    for name, data, why in (("bom", b'\xef\xbb\xbf{"k": 1}', "byte order"), ("bad", b'{"k": 1, "v": "\xff"}', "UTF-8"), ("third", b'{"k": 1}\n\n{"k": "x"}', "mixes types"), ("line", b'{"k": 5}\n\n{"k"}', "line 3")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ImportRejected, match=why):
            jsonl.import_file(Memory(spark), "x.F", str(tmp_path / name), {"k": "integer"})


# -- predicates ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def items(spark):
    m = Memory(spark, "items")
    jsonl.import_jsonl(m, "a.Item", lines(spark, [{"k": 1, "s": "x", "n": 1, "u": None}, {"k": 2, "s": "y", "n": 1.0}, {"k": 3, "s": None, "n": 2.5, "b": True}, {"k": 4, "b": False, "n": 2**53 - 1}]), {"k": "integer"})
    return m


def matching(m, version, *w):
    nodes = {"nodes": [{"type": "a.Item", "as": "i"}]}
    if version == 1:
        got = compile.run_v1(m, parse_v1({"query_ir_version": "1", "match": nodes, "where": [where(*w)], "return": [{"field": "i.k"}]}))
        return sorted(int(r["i_k"]) for r in got.collect())
    rows = aggregate.binding_frame(m, parse_v2({"query_ir_version": "2", "match": nodes, "where": [where(*w)], "measures": [{"as": "n", "op": "count", "node": "i"}]}))
    return sorted(int(r["i__v_k"]) for r in rows.collect())


@pytest.mark.parametrize(
    "w,v1,v2",
    [
        (("i.s", "eq", "x"), [1], [1]), (("i.s", "in", "x"), [1], [1]), (("i.s", "ne", "x"), [2, 3], [2]), (("i.s", "eq", None), [3], [3]), (("i.u", "eq", None), [], [1]), (("i.s", "ne", None), [1, 2], []),
        (("i.s", "in", None, "x"), [1, 3], [1, 3]), (("i.s", "exists"), [1, 2, 3], [1, 2, 3]), (("i.s", "gte", "X"), [1, 2], [1, 2]), (("i.s", "lt", "Y"), [1], []), (("i.s", "lt", None), [], []),
        (("i.n", "eq", 1), [1], [1]), (("i.n", "eq", 1.0), [2], [2]), (("i.n", "lte", 1), [1, 2], [1, 2]), (("i.n", "gt", 2**53 - 2), [4], [4]), (("i.b", "eq", True), [3], [3]), (("i.b", "ne", True), [4], [4]),
    ],
)
def test_predicates(items, w, v1, v2):
    assert matching(items, 1, *w) == v1 and matching(items, 2, *w) == v2


def test_predicate_and_document_errors(items):
    for w in (("i.s", "eq", 1), ("i.b", "lt", True), ("i.zz", "eq", 1), ("j.s", "eq", "x"), ("i.s", "like", "x")):
        with pytest.raises(QueryValidationError):
            matching(items, 1, *w)
    with pytest.raises(QueryValidationError):
        parse_v1({"query_ir_version": "1", "match": {"nodes": [{"type": "a", "as": "a"}, {"type": "b", "as": "b"}]}, "return": [{"count": True}]})
    with pytest.raises(QueryValidationError):
        parse_v1({"query_ir_version": "1", "match": {"nodes": [{"type": "a", "as": "a"}]}, "return": [{"field": "a.x"}], "limit": 1001})


def test_typed_keys_and_coverage(items):
    q = {"query_ir_version": "2", "match": {"nodes": [{"type": "a.Item", "as": "i"}]}, "group_by": [{"field": "i.s", "as": "s"}], "measures": [{"as": "n", "op": "count", "node": "i"}, {"as": "k", "op": "sum", "field": "i.k"}], "order_by": [{"result": "s", "direction": "desc"}]}
    rows = aggregate.run_v2(items, parse_v2(q)).collect()
    assert [(r["s_kind"], r["s"], r["k"]) for r in rows] == [("value", "y", 2), ("value", "x", 1), ("null", None, 3), ("missing", None, 4)]
    q = q | {"group_by": [{"field": "i.n", "as": "n1"}], "order_by": [], "measures": q["measures"][:1]}
    assert {r["n1"] for r in aggregate.run_v2(items, parse_v2(q)).collect()} == {"1", "1.0", "2.5", str(2**53 - 1)}
    bad = q | {"group_by": [], "measures": [{"as": "s", "op": "sum", "field": "i.n"}]}
    with pytest.raises(Exception, match="analytics_error"):
        aggregate.run_v2(items, parse_v2(bad)).collect()
    good = bad | {"where": [where("i.n", "lt", 2)]}
    assert aggregate.run_v2(items, parse_v2(good)).first()["s"] == 2


def test_exact_ratio_and_order(spark):
    rnd = random.Random(4)
    top = 2**53 - 1
    pairs = [(rnd.randint(-top, top), rnd.choice([1, -1]) * rnd.randint(1, top)) for _ in range(300)] + [(1, 3), (2, 3), (-1, 8 * 10**12), (1, 2 * 10**12), (3, 2 * 10**12), (0, -5), (top, top - 1), (top - 1, top), (10**12 * 2 - 1, 2 * 10**12), (5, 0)]
    df = spark.createDataFrame(pairs, "n long, d long")
    with localcontext() as ctx:
        ctx.prec = 60
        for r in df.select("n", "d", values.exact_ratio(F.col("n"), F.col("d")).alias("x")).collect():
            want = None if not r["d"] else (Decimal(r["n"]) / Decimal(r["d"])).quantize(Decimal("1e-12"), ROUND_HALF_EVEN)
            assert r["x"] == (None if want is None else f"{want:f}"), r
    got = [Fraction(r["n"], r["d"]) for r in df.filter("d <> 0").orderBy(values.ratio_sort_key(F.col("n"), F.col("d"))).collect()]
    assert got == sorted(got)


# -- ingestion ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bad", ['{"k": 1, "k": 2}', "[1]", '{"k": NaN}', '{"k": null}', '{"v": 1}', '{"k": "x"}', '{"k": 1.5}', '{"k": 1, "password": "x"}', '{"k"', '{"k": 7}\n{"k": 7}', '{"k": 1, "v": 1}\n{"k": 2, "v": "a"}'])
def test_bad_lines_are_rejected(spark, bad):
    with pytest.raises(ImportRejected):
        jsonl.import_jsonl(Memory(spark), "a.B", lines(spark, bad.split("\n")), {"k": "integer"})


def test_import_replay_ambiguity_backfill_required(spark):
    m = Memory(spark)
    docs = [{"t": "a", "c": 1, "v": None}, {"t": "a", "c": 2}]
    first = jsonl.import_jsonl(m, "a.B", lines(spark, docs), {"t": "string", "c": "integer"})
    revision = m.revision
    again = jsonl.import_jsonl(m, "a.B", lines(spark, docs), {"t": "string", "c": "integer"})
    assert first["created"] == 2 and again["replayed"] and m.revision == revision
    assert m.entity("a.B").field("v").kind == "unresolved"
    patch = jsonl.import_jsonl(m, "a.B", lines(spark, [{"t": "a", "c": 2, "v": 5}]), {"t": "string", "c": "integer"})
    assert patch["updated"] == 1 and patch["ontology_delta"]["resolved_types"] == ["v"]
    assert {(r["v_v"], r["p_v"]) for r in m.entity("a.B").df.collect()} == {(5.0, True), (None, True)}
    with pytest.raises(ImportRejected, match="ambiguous"):
        jsonl.import_jsonl(m, "a.B", lines(spark, [{"t": "a", "v": 1}]), {"t": "string"})
    with pytest.raises(QueryValidationError):
        jsonl.declare(m, "a.B", {"v": {"nullable": False}})
    jsonl.declare(m, "a.B", {"v": {"required": True}, "t": {"searchable": True}})
    with pytest.raises(ImportRejected, match="required"):
        jsonl.import_jsonl(m, "a.B", lines(spark, [{"t": "z", "c": 9}]), {"t": "string", "c": "integer"})


def test_array_join(spark):
    m = Memory(spark)
    jsonl.import_jsonl(m, "a.Source", lines(spark, [{"id": "1", "codes": ["a", "b", "a", None]}, {"id": "2", "codes": [None]}, {"id": "3", "codes": ["zz"]}]), {"id": "string"})
    jsonl.import_jsonl(m, "a.Code", lines(spark, [{"id": "a"}, {"id": "b"}]), {"id": "string"})
    got = relate.materialize_join(m, "j", "code", {"from": {"type": "a.Source", "fields": ["codes"]}, "to": {"type": "a.Code", "fields": ["id"]}}).first()
    assert (got["created"], got["skipped_null_or_missing"], got["skipped_unmatched"]) == (2, 1, 1)
    jsonl.import_jsonl(m, "a.Bad", lines(spark, [{"id": "1", "codes": [{"x": 1}]}]), {"id": "string"})
    with pytest.raises(Exception, match="scalar elements"):
        relate.matched_edges(m, {"from": {"type": "a.Bad", "fields": ["codes"]}, "to": {"type": "a.Code", "fields": ["id"]}}).collect()
    jsonl.import_jsonl(m, "a.Two", lines(spark, [{"id": "1", "c": "a"}, {"id": "2", "c": "a"}]), {"id": "string"})
    with pytest.raises(Exception, match="ambiguous_target"):
        relate.matched_edges(m, {"from": {"type": "a.Source", "fields": ["codes"]}, "to": {"type": "a.Two", "fields": ["c"]}}).collect()


# -- traversal, search, lifecycle, evidence, store ---------------------------------------------------------------
def test_traversal_limits(spark):
    m = Memory(spark)
    df = spark.createDataFrame([(c,) for c in "ABCDE"], "id string")
    m.register_entity("g.Node", df, "id", {"id": ("string", "id")})
    m.register_relation("parent", "g.Node", "g.Node", spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "C"), ("E", "D")], "source string, target string"), "p")
    got = traverse.traverse(m, "g.Node:A", direction="inbound", max_depth=3)
    assert got["nodes"] == {"g.Node:A": 0, "g.Node:B": 1, "g.Node:C": 2, "g.Node:D": 3} and got["truncated"]
    assert not traverse.traverse(m, "g.Node:A", direction="inbound", max_depth=4)["truncated"]
    assert len(traverse.traverse(m, "g.Node:C", direction="both", max_depth=8, limit=2)["edges"]) == 2
    assert traverse.traverse(m, "g.Node:C", direction="both", max_depth=8, limit=2)["truncated"]
    m.deactivate_relation("p", F.col("source") == "C")
    assert set(traverse.traverse(m, "g.Node:A", direction="inbound")["nodes"]) == {"g.Node:A", "g.Node:B"}


def test_search_and_embeddings(spark):
    m = Memory(spark)
    df = spark.createDataFrame([(1, "the running man"), (2, "run the run"), (3, "other")], "id long, t string")
    m.register_entity("s.Doc", df, "id", {"t": ("string", "t", None, {"searchable": True})}, privacy=F.when(F.col("id") == 2, "private").otherwise("public"))
    docs = search.search_documents(m)
    assert {r["node_id"] for r in search.fts(docs, ["RUN", "the"], ["node_id"]).collect()} == {"2"}
    empty = spark.createDataFrame([], "node_id string, content_hash string")
    todo = search.missing_embeddings(docs, empty, ["node_id"])
    vectors = search.embed(todo, lambda texts: [[1.0, 0.0] if "running" in t else [0.0, 1.0] for t in texts], ["node_id"])
    top = search.semantic_top_k(vectors, [1.0, 0.0], "node_id", "embedding", 5).collect()
    assert [r["node_id"] for r in top] == ["1", "3"]
    assert search.missing_embeddings(docs, vectors, ["node_id"]).count() == 0
    made = index.TextIndex.build(docs, ["node_id"], state=m.state())
    assert made.current(m)
    for terms in (["RUN", "the"], ["the"], ["nowhere"], ["other", "nowhere"]):
        want = {r["node_id"]: round(r["score"], 9) for r in search.fts(docs, terms, ["node_id"]).collect()}
        assert {r["node_id"]: round(r["score"], 9) for r in made.search(terms).collect()} == want
    m.reclassify("s.Doc", F.lit("public"))
    assert not made.current(m)
    assert {r["status"]: r["n"] for r in search.embedding_coverage(docs, vectors, ["node_id"]).collect()} == {"private": 1, "ready": 2}
    assert {r["status"]: r["n"] for r in search.embedding_coverage(docs.filter("node_id <> '3'").withColumn("text", F.upper("text")), vectors, ["node_id"]).collect()} == {"private": 1, "stale": 1, "orphaned": 1}
    with pytest.raises(QueryValidationError):
        search.semantic_top_k(vectors, [1.0], "node_id", "embedding", 5, dims=2)
    assert [r["node_id"] for r in search.semantic_top_k(vectors, [1.0, 0.0], "node_id", "embedding", 5, F.col("node_id") != "1", 2).collect()] == ["3"]


def test_index_follows_its_model(spark, tmp_path, monkeypatch):
    """Random changes: searches equal those of an index built anew, and drift is seen both ways; segments stay few."""
    r, said = random.Random(4), "the run stop go far near far far".split()
    model = {i: " ".join(r.choices(said, k=r.randrange(9))) for i in range(30)} | {None: "the null run"}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "node_id long, text string")
    made = index.TextIndex.build(frame(model), ["node_id"], str(tmp_path / "i"))
    for step in range(7):
        before = dict(model)
        for i in r.sample(range(40), 6):
            model[i] = " ".join(r.choices(said, k=r.randrange(9)))
        for i in r.sample(sorted(k for k in model if k is not None), 3):
            del model[i]
        status = {x["node_id"]: x["status"] for x in made.drift(frame(model)).collect()}
        assert status == {k: "extra" if k not in model else "missing" if k not in before else "stale" for k in {*before, *model} if before.get(k) != model.get(k) or (k in before) != (k in model)}
        assert made.coverage(frame(model)).first()["complete"] == all(s == "extra" for s in status.values())
        got = made.refresh(frame(model), state={"step": step})
        assert sum(got.values()) == len(status) and made.drift(frame(model)).isEmpty() and made.manifest["state"] == {"step": step}
        assert made.manifest["n"] == len(model) and made.manifest["words"] == sum(len(x.split()) for x in model.values())
    assert len(made.manifest["segments"]) < 6
    again = index.TextIndex(spark, made.path)
    for terms in (["far"], ["the", "run"], ["nowhere"]):
        want = {x["node_id"]: round(x["score"], 9) for x in search.fts(frame(model), terms, ["node_id"]).collect()}
        assert {x["node_id"]: round(x["score"], 9) for x in again.search(terms).collect()} == want
    made.refresh(frame(model).limit(0))
    assert made.search(["far"]).isEmpty() and made.documents().isEmpty() and made.manifest["n"] == 0


def test_capture_freshness_and_bundles(spark, plant, tmp_path):
    doc, root = query(group_by=[{"field": "m.maker", "as": "maker"}]), str(tmp_path)
    seen = observations.capture(plant, root, {"a": doc}, "v1", plant.state())
    assert seen["freshness"] == "current" and seen["fully_public"] and observations.table(spark, root, seen["identity"], "a", "results").count() == 3
    assert observations.capture(plant, root, {"a": doc | {"limit": 1, "order_by": [{"result": "rate"}]}}, "v1")["identity"] == seen["identity"]
    before = plant.state()
    jsonl.import_jsonl(plant, "plant.Fault", lines(spark, [{"no": "F3", "code": "heat"}]), {"no": "string"})
    assert observations.read(spark, root, seen["identity"], plant)["freshness"] == "potentially_stale"
    with pytest.raises(StaleResultError):
        aggregate.execute_bundle(plant, {"a": parse_v2(doc)}, expected_state=before)
    assert observations.damaged(spark, root, seen["identity"]) == []
    folder = tmp_path / "observations" / seen["identity"]
    leaf = next((folder / "a" / "members").glob("*.parquet"))
    kept = leaf.read_bytes()
    leaf.with_name("." + leaf.name + ".crc").unlink(missing_ok=True)
    leaf.write_bytes(kept[:-1] + bytes([kept[-1] ^ 1]))
    assert observations.damaged(spark, root, seen["identity"]) == ["a/members"]
    with pytest.raises(StaleResultError):
        observations.drill(spark, root, seen["identity"], "a", {}, "counted_entities", doc["measures"][0]["as"]).count()
    path = folder / "manifest.json"
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    path.write_text(path.read_text().replace('"v1"', '"v2"'))
    with pytest.raises(StaleResultError):
        observations.read(spark, root, seen["identity"])


def test_members_of_one_pattern_share_its_matches(spark, plant):
    group = {"group_by": [{"field": "m.maker", "as": "maker"}]}
    docs = {"all": query(), "by": query(**group), "dock": query(where=[where("m.site", "eq", "dock")]), "old": query(where=[where("m.hours", "gt", 1300)], **group), "other": query(optional_match=[], measures=[{"as": "n", "op": "count", "node": "m"}], derive=[])}
    members = {n: parse_v2(d) for n, d in docs.items()}
    rows = lambda df: sorted(map(str, df.collect()))
    got = aggregate.execute_bundle(plant, members)
    assert {n: rows(df) for n, df in got.items()} == {n: rows(aggregate.run_v2(plant, q)) for n, q in members.items()}
    read = {f for n in ("all", "by", "dock", "old") for f in got[n].inputFiles()}
    assert read and all("factloom-matches" in f for f in read)  # neither entities nor edges
    assert set(aggregate.shared_matches(plant, members)) == {"all", "by", "dock", "old"}


def test_embeddings_resume(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider(texts):
        for t in texts:
            if t == "fails" and not (calls / "mended").exists():
                raise ValueError("no")
            with open(calls / f"{t}-{uuid.uuid4().hex}", "w"):
                pass
        return [[3.0, float(len(t))] for t in texts]

    rows = [(i, f"t{i % 20}", "public") for i in range(60)] + [(99, "hidden", "private"), (98, "fails", "public"), (97, None, "public")]
    docs = spark.createDataFrame(rows, "id long, text string, privacy string")
    made = embeddings.Embeddings(spark, str(tmp_path), "p", 2)
    assert made.status(docs) == "pending"
    with pytest.raises(Exception, match="no"):
        made.rebuild(docs, provider, batch=1)
    kept = {r["content_hash"] for r in made.records().collect()}
    assert made.status(docs) == "degraded"
    (calls / "mended").touch()
    before = len(list(calls.iterdir()))
    again = embeddings.Embeddings(spark, str(tmp_path), "p", 2)
    assert again.rebuild(docs, provider, batch=1) == 21 - len(kept) == len(list(calls.iterdir())) - before and again.status(docs) == "ready"
    assert again.vectors(docs, ["id"]).count() == 61 and again.rebuild(docs, provider) == 0
    v = again.vectors(docs, ["id"]).filter("id = 0").first()["embedding"]
    assert np.array(v, np.float32).tolist() == v and abs(np.linalg.norm(v) - 1) < 1e-6
    assert again.status(docs.union(spark.createDataFrame([(1, "new", "public")], docs.schema))) == "degraded"
    with pytest.raises(FactloomError):
        embeddings.Embeddings(spark, str(tmp_path), "p", 3)
    for bad in ([[1.0]], [[0.0, 0.0]], [[float("nan"), 1.0]]):
        with pytest.raises(FactloomError):
            embeddings.normalised(bad, 2)


def test_provenance_is_beside_the_plans(spark, tmp_path):
    m = Memory(spark, "p")
    key = {"k": "integer"}
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"k": 1, "s": "x", "n": 1}, {"k": 2, "s": None}]), key, source={"kind": "file", "locator": "one"})
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"k": 1, "s": "y"}]), key, source={"kind": "file", "locator": "two", "fragment_id": "f9"})
    revision = m.revision
    again = jsonl.import_jsonl(m, "a.T", lines(spark, [{"k": 1, "s": "y"}, {"k": 2}]), key, source={"kind": "file", "locator": "three"})
    assert again == {"created": 0, "updated": 2, "ontology_delta": again["ontology_delta"], "replayed": False} and m.revision == revision
    doc = {"query_ir_version": "1", "match": {"nodes": [{"type": "a.T", "as": "t"}]}, "return": [{"field": "t.s"}, {"field": "t.n"}], "order_by": [{"field": "t.k", "direction": "desc"}]}
    rows = compile.run_v1(m, parse_v1(doc), provenance=True).collect()
    locators = {r["source_id"]: r["locator"] for r in provenance.catalog(m, "sources").collect()}
    assert [(locators.get(r["t_s_source_id"]), locators.get(r["t_n_source_id"]), r["t_n_attribute_id"] is None) for r in rows] == [("one", None, True), ("three", "one", False)]
    plan = compile.run_v1(m, parse_v1(doc))._jdf.queryExecution().toString()
    assert "source_id" not in plan and "batch_id" not in plan
    assert [(r["field"], r["missing"]) for r in provenance.dangling(m, "a.T").collect()] == []  # the third import wrote over the unknown fragment
    provenance.add(m, "a.T", m.entity("a.T").df.select("id", F.lit("n").alias("field")), fragment_id="gone", updated_at=datetime(2024, 1, 1))
    assert [(r["field"], r["missing"]) for r in provenance.dangling(m, "a.T").collect()] == [("n", "fragment")]
    store.save(m, str(tmp_path))
    back = store.load(spark, str(tmp_path), "p")
    assert sorted(map(tuple, provenance.latest(back, "a.T").collect())) == sorted(map(tuple, provenance.latest(m, "a.T").collect()))
    m.delete_nodes("a.T", m.entity("a.T").df.filter("i_k = 2"))
    assert {r["id"] for r in provenance.latest(m, "a.T").collect()} == {r["id"] for r in m.entity("a.T").df.collect()}


def test_written_numbers_group_and_compare(spark, plant):
    e = plant.entity("plant.Machine").df
    values = e.select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("value"))
    writes.write_attribute(plant, "plant.Machine", "rank", "number", values, "r")
    doc = {"query_ir_version": "1", "match": {"nodes": [{"type": "plant.Machine", "as": "m"}]}, "where": [where("m.rank", "eq", 2)], "return": [{"field": "m.rank"}]}
    assert [r["m_rank_text"] for r in compile.run_v1(plant, parse_v1(doc)).collect()] == ["2"]
    groups = aggregate.groups(plant, parse_v2({"query_ir_version": "2", "match": doc["match"], "group_by": [{"field": "m.rank", "as": "rank"}], "measures": [{"as": "n", "op": "count", "node": "m"}]}))
    assert sorted(r["rank"] for r in groups.collect()) == sorted(str(i + 1) for i in range(e.count()))
    writes.write_attribute(plant, "plant.Machine", "tags", "array", e.limit(1).select("id", F.lit('[2, "b" ]').alias("value")), "r")
    assert [r["c_tags"] for r in plant.entity("plant.Machine").df.filter("p_tags").collect()] == ['[2,"b"]']
    writes.write_attribute(plant, "plant.Machine", "share", "number", e.select("id", F.lit(0.1).alias("value")), "r2")
    assert {(r["c_share"], r["i_share"]) for r in plant.entity("plant.Machine").df.collect()} == {("0.1", None)}


def test_array_elements_keep_their_types(spark):
    def edges(element, field):
        m = Memory(spark, "x")
        jsonl.import_jsonl(m, "a.S", lines(spark, [{"id": 1, "codes": element}]), {"id": "integer"})
        jsonl.import_jsonl(m, "a.T", lines(spark, [{"id": "t", "v": v} for v in field]), {"id": "string"} if len(field) == 1 else {"id": "string", "v": "integer"})
        relate.materialize_join(m, "j", "r", {"from": {"type": "a.S", "fields": ["codes"]}, "to": {"type": "a.T", "fields": ["v"]}})
        return m.edges("r", "a.S", "a.T", "j").count()

    assert edges([5, None, 5, 6], [5, 6]) == 2 and edges(["5", None], ["5"]) == 1 and edges([True], [True]) == 1 and edges([5.0], [5]) == 0
    for element, field in ((["5"], [5]), ([5], ["5"]), ([True], ["true"]), (["true"], [True]), ([5, "5"], [5]), ([[5]], [5])):
        with pytest.raises(Exception, match="incompatible types|scalar elements"):
            edges(element, field)


def test_keys_that_look_alike(spark):
    m = Memory(spark, "x")
    jsonl.import_jsonl(m, "a.P", lines(spark, [{"a": "x\x1fy", "b": "z"}, {"a": "x", "b": "y\x1fz"}, {"a": 'x","y', "b": "z"}, {"a": "x", "b": 'y","z'}]), {"a": "string", "b": "string"})
    assert len({r["id"] for r in m.entity("a.P").df.collect()}) == 4


def test_store_round_trip_and_transfer(spark, plant, tmp_path):
    store.save(plant, str(tmp_path / "a"))
    back = store.load(spark, str(tmp_path / "a"), "plant")
    assert back.state() == plant.state() and back.ontology_fingerprint() == plant.ontology_fingerprint()
    assert aggregate.run_v2(back, parse_v2(query())).collect() == aggregate.run_v2(plant, parse_v2(query())).collect()
    store.export_transfer(plant, str(tmp_path / "b"))
    moved = store.import_transfer(spark, str(tmp_path / "b"), "plant")
    assert moved.revision == 0 and moved.generation != plant.generation and aggregate.run_v2(moved, parse_v2(query())).first()["hit"] == by_hand(MACHINES, FAULTS)["hit"]


def test_fragments_and_evidence(spark, tmp_path):
    data = b'{"id":1,"t":"2024-01-01T00:00:00Z","a":[10,{"b/c":2}]}\n{"id":2,"t":"2024-01-02T00:00:00Z"}\n'
    digest = fragments.put(spark, str(tmp_path), data)
    assert fragments.put(spark, str(tmp_path), data) == digest and fragments.read(spark, str(tmp_path), digest, 0, 5) == {"data": data[:5], "eof": False}
    assert fragments.extract(spark, data, {"kind": "byte_range", "start": 1, "end": 5}) == data[1:5]
    assert fragments.extract(spark, data, {"kind": "byte_range", "start": 3, "end": 3}) == b"" and fragments.extract(spark, data, None) == data
    assert fragments.extract(spark, data, {"kind": "line_range", "start_line": 2, "end_line": 2}) == data.splitlines(keepends=True)[1]
    of_lines = {"input_format": "jsonl"}
    assert fragments.extract(spark, data, {"kind": "record_key", "key_field": "id", "key_value": 2} | of_lines) == b'{"id":2,"t":"2024-01-02T00:00:00Z"}\n'
    # 23:30 two hours west of UTC is 01:30 on the next day
    day = {"kind": "time_interval", "timestamp_field": "t", "start": "2024-01-01T23:30:00-02:00", "end": "2024-01-03T00:00:00Z"} | of_lines
    assert fragments.extract(spark, data, day) == b"" and fragments.extract(spark, data, day | {"start": "2024-01-01T23:30:00+02:00"}) == b'{"id":2,"t":"2024-01-02T00:00:00Z"}\n'
    assert fragments.extract(spark, data.splitlines()[0], {"kind": "structured", "pointer": "/a/1/b~1c"}) == b"2"
    sound = {"kind": "sample_interval", "start_sample": 1, "end_sample": 2, "sample_rate": 8000, "channels": 2, "bit_width": 16, "sample_format": "pcm", "byte_order": "little", "interleaved": True}
    assert fragments.extract(spark, bytes(range(12)), sound) == bytes([4, 5, 6, 7])
    assert fragments.extract(spark, bytes(range(12)), sound | {"interleaved": False}) == bytes([2, 3, 8, 9])
    refused = [
        {"kind": "byte_range", "start": 5, "end": 3}, {"kind": "byte_range", "start": 0, "end": 10**6}, {"kind": "byte_range", "start": True, "end": 3}, {"kind": "line_range", "start_line": 0, "end_line": 1}, {"kind": "byte_range", "start": 0, "end": 1, "x": 1},
        day | {"timestamp_field": "id"}, day | {"start": "2024-01-04T00:00:00Z"}, day | {"start": "2024-01-01"}, sound | {"bit_width": 12}, sound | {"channels": 5}, sound | {"end_sample": 4}, {"kind": "record_key", "key_field": "x", "key_value": None} | of_lines, {"kind": "nothing"},
    ]
    for selector in refused:
        with pytest.raises(FactloomError):
            fragments.extract(spark, data, selector) if selector["kind"] != "sample_interval" else fragments.extract(spark, bytes(range(12)), selector)
    many = spark.createDataFrame([(digest, data, json.dumps({"kind": "byte_range", "start": 1, "end": 5})), ("x", b"", json.dumps({"kind": "byte_range", "start": 1, "end": 5}))], "digest string, content binary, selector string")
    got = {r["digest"]: (r["fragment"], r["error"]) for r in fragments.fragments(many).collect()}
    assert bytes(got[digest][0]) == data[1:5] and got["x"][0] is None and "range" in got["x"][1]
    small = spark.createDataFrame([(digest, len(data)), ("f" * 64, 9), ("e" * 64, 9 << 20)], "digest string, size long")
    status = {r["digest"][:1]: (r["availability"], r["verification"]) for r in fragments.source_status(spark, str(tmp_path), small).collect()}
    assert status == {digest[:1]: ("available", "verified"), "f": ("missing", "unverified"), "e": ("unknown", "unverified")}
    known = spark.createDataFrame([(digest,), ("f" * 64,)], "digest string")
    assert {(r["digest"], r["status"]) for r in fragments.audit(spark, str(tmp_path), known).collect()} == {(digest, "ok"), ("f" * 64, "missing")}


def test_values():
    assert values.canonical_json({"b": 1, "a": ["é", 1.0]}) == '{"a":["é",1.0],"b":1}'
    assert values.normalize_timestamp("2024-01-01T02:00:00.5+02:00") == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        values.normalize_timestamp("2024-01-01T02:00:00")
    assert values.stable_uuid("x", 1) == values.stable_uuid("x", 1) != values.stable_uuid("x", 1.0)
    assert values.normalize_text(" é\r\n") == "é"
    assert values.json_pointer({"": {"a": [1]}}, "//a/0") == 1


def test_casefold_matches_python(spark):
    got = spark.createDataFrame([("Straße",), ("ΑΣ",), ("Item10",)], "s string").select(values.casefold(F.col("s")).alias("f"), values.nfc(F.col("s")).alias("n")).collect()
    assert [r["f"] for r in got] == ["strasse", "ασ", "item10"]


def test_stream(spark, tmp_path):
    from factloom.streaming.ingest import import_batch, stream_jsonl

    root, ck = (tmp_path / "store").as_uri(), str(tmp_path / "ck")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    stream_jsonl(spark, root, str(tmp_path / "in"), "a.B", {"k": "integer"}, ck).awaitTermination(120)
    (tmp_path / "in" / "b.jsonl").write_text('{"k": 2, "v": "c"}\n{"k": 3, "v": "d"}\n')
    stream_jsonl(spark, root, str(tmp_path / "in"), "a.B", {"k": "integer"}, ck).awaitTermination(120)
    kept = VersionStore(spark, root)
    m = kept.load()
    assert sorted((r["c_k"], r["v_v"]) for r in m.entity("a.B").df.collect()) == [("1", "a"), ("2", "c"), ("3", "d")] and kept.numbers() == [1, 2]
    # A batch that dies before its commit is imported when it comes again; one that dies after it is replayed.
    lost = kept.load()
    jsonl.import_jsonl(lost, "a.B", lines(spark, [{"k": 4}]), {"k": "integer"}, content_hash=f"{ck}#2")
    assert not import_batch(kept, lines(spark, [{"k": 4}]), 2, "a.B", {"k": "integer"}, ck)["replayed"]
    assert import_batch(kept, lines(spark, [{"k": 4}]), 2, "a.B", {"k": "integer"}, ck)["replayed"] and kept.numbers() == [1, 2, 3]
    with pytest.raises(StaleResultError):
        kept.commit(lost)


def test_commits_hold_what_changed(spark, tmp_path):
    """Random writes: each commit reads back as the memory was, earlier ones still do, and small changes write little."""
    r, kept = random.Random(8), VersionStore(spark, (tmp_path / "s").as_uri())
    m, key, was = kept.load(), {"k": "integer"}, {}
    seen = lambda x: {n: sorted(map(str, e.df.select(*sorted(e.df.columns)).collect())) for n, e in x.entities.items()} | {y.name: sorted(map(str, y.df.collect())) for y in x.relations}
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"k": k} for k in range(5)]), key)
    jsonl.import_jsonl(m, "a.S", lines(spark, [{"k": k, "t": k % 6, "x": "s"} for k in range(200)]), key)
    join = {"from": {"type": "a.S", "fields": ["t"]}, "to": {"type": "a.T", "fields": ["k"]}}
    for step in range(5):
        relate.materialize_join(m, "s_t", "of", join)
        if step == 1:
            m.delete_nodes("a.S", m.entity("a.S").df.filter("i_k % 50 = 7"))
        if step == 2:
            m.deactivate_relation("s_t", F.col("target").isNotNull() & F.col("source").startswith("a"))
            writes.write_attribute(m, "a.S", "n", "number", m.entity("a.S").df.filter("i_k < 3").select("id", F.lit(2).cast("long").alias("value")), "r")
        if step == 3:
            m.reclassify("a.T", F.when(F.col("i_k") == 1, "private").otherwise("public"))
        n = kept.commit(m)
        was[n], back = seen(m), kept.load()
        assert seen(back) == was[n] and back.state() == m.state() and back.imports == m.imports
        m = back
        jsonl.import_jsonl(m, "a.S", lines(spark, [{"k": k, "x": f"p{step}"} for k in r.sample(range(210), 2)]), key)
    assert all(seen(kept.load(n)) == was[n] for n in was) and kept.load().commit == 5
    assert kept.size(1)["a.S"] == 200 and 0 < kept.size(2)["a.S"] <= 6 and kept.size(5) == {"a.T": 0, "a.S": 2, "of": kept.size(5)["of"]} and kept.size(5)["of"] <= 2
    facts = sorted(map(str, provenance.latest(m, "a.S").collect()))
    assert kept.commit(m) == 6 and sorted(map(str, provenance.latest(kept.load(), "a.S").collect())) == facts


def test_writes_wipe_memories_snapshot(spark, plant, tmp_path):
    from factloom.operators import writes
    from factloom.sources import snapshot

    doubled = writes.attribute_expression(plant, "plant.Machine", (F.col("i_hours") * 2).cast("long"))
    assert not writes.write_attribute(plant, "plant.Machine", "twice", "long", doubled, "run-1")["replayed"]
    assert writes.write_attribute(plant, "plant.Machine", "twice", "long", doubled, "run-1")["replayed"]
    q = query(optional_match=[], measures=[{"as": "s", "op": "sum", "field": "m.twice"}], derive=[])
    assert aggregate.run_v2(plant, parse_v2(q)).first()["s"] == 2 * sum(m["hours"] for m in MACHINES)
    with pytest.raises(ImportRejected):
        writes.write_attribute(plant, "plant.Machine", "maker", "long", doubled, "run-2")
    with pytest.raises(ImportRejected):
        writes.write_attribute(plant, "plant.Machine", "x", "long", spark.createDataFrame([("no", 1)], "id string, value long"), "run-3")
    assert writes.declare_namespace(plant, "plant", "a plant") and not writes.declare_namespace(plant, "plant", "a plant")
    snapshot.create(plant, str(tmp_path / "a.zip"))
    snapshot.create(plant, str(tmp_path / "b.zip"))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    back = snapshot.restore(spark, str(tmp_path / "a.zip"))
    assert aggregate.run_v2(back, parse_v2(query())).collect() == aggregate.run_v2(plant, parse_v2(query())).collect()
    memories = writes.Memories(spark, str(tmp_path / "m"))
    assert memories.names() == ["default"]
    memories.save(plant)
    assert memories.names() == ["default", "plant"] and memories.open("plant").state() == plant.state()
    with pytest.raises(QueryValidationError):
        memories.destroy("plant", {})
    memories.destroy("plant", writes.fingerprint(memories.open("plant")))
    assert memories.names() == ["default"]
    with pytest.raises(QueryValidationError):
        writes.wipe(plant, {})
    assert not writes.wipe(plant, writes.fingerprint(plant)).entities


def test_metrics_and_retirement(spark, tmp_path):
    metrics = spark.createDataFrame([], writes.METRICS)
    for run, n in (("r1", 1), ("r2", 3), ("r2", 3)):
        metrics = writes.write_metric(metrics, run, datetime(2024, 1, int(run[1])), "d", {"a": 1}, n, 4)
    assert metrics.count() == 2 and lifecycle.current_metrics(metrics).first()["value"] == 0.75
    free, held = fragments.put(spark, str(tmp_path), b"free"), fragments.put(spark, str(tmp_path), b"held")
    evidence = spark.createDataFrame([(free, False, None, False), (held, True, None, False)], "digest string, retention_required boolean, retain_until timestamp, retired boolean")
    none = spark.createDataFrame([], "digest string")
    listed = [r["digest"] for r in writes.retirable(evidence, "2024-01-01", none).collect()]
    plan = writes.plan_retirement(spark, listed, str(tmp_path), "2024-01-01")
    assert listed == [free] and writes.retire(spark, str(tmp_path), plan) == [free]
    assert {r["status"] for r in fragments.audit(spark, str(tmp_path), evidence).collect()} == {"ok", "missing"}


def test_refreshed_joins_equal_full_runs(spark, tmp_path):
    """Random patches, deletions and deactivations: after each, edges and counters are those of a full run on the same tables."""
    rng, join = random.Random(5), {"from": {"type": "a.S", "fields": ["k"]}, "to": {"type": "a.T", "fields": ["k"]}}
    key = {"n": "integer"}
    store = VersionStore(spark, str(tmp_path / "commits"))
    m = store.load()
    jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": i, "k": None if i % 9 == 0 else [f"k{i % 20}", f"k{(i * 7) % 23}"]} for i in range(60)]), key)
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"n": i, "k": f"k{i}"} for i in range(18)]), key)
    kept = lambda: maintain.JoinIndex(m, str(tmp_path / "index"), "j", "r", join, 4)
    first = kept().build()
    assert first["created"] > 0 and kept().refresh() == {**first, "created": 0, "previously_active": first["created"], "rebuilt": False, "rematched": 0}
    for step in range(5):
        if step == 4:  # what was committed with the index is known to it
            store.commit(m)
            m = store.load()
        some = rng.sample(range(70), 4)
        if step != 3:
            jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": i, "k": rng.choice([None, [], [f"k{rng.randrange(24)}"], ["k1", "k2", None]])} for i in some]), key)
        if step in (1, 4):  # another key, which no other target has
            jsonl.import_jsonl(m, "a.T", lines(spark, [{"n": step, "k": f"new{step}"}, {"n": 100 + step, "k": f"k{18 + step}"}]), key)
        if step == 2:
            m.delete_nodes("a.T", m.entity("a.T").df.filter("i_n = 2"))
            m.delete_nodes("a.S", m.entity("a.S").df.filter(f"i_n = {some[0]}"))
        if step == 3:
            m.deactivate_relation("j", F.col("target").isin([r["id"] for r in m.entity("a.T").df.filter("v_k = 'k3'").select("id").collect()]))
        full = copy.copy(m)
        full.relations, full.changes = list(m.relations), {n: list(c) for n, c in m.changes.items()}
        want = relate.materialize_join(full, "j", "r", join).first().asDict()
        got = kept().refresh()
        assert not got.pop("rebuilt") and got.pop("rematched") < 60 and got == want
        rows = lambda x: sorted(map(tuple, x.relations[0].df.collect()))
        assert rows(m) == rows(full)
    before, revision = rows(m), m.revision
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"n": 200, "k": "k5"}]), key)
    with pytest.raises(Exception, match="ambiguous_target"):
        kept().refresh()
    assert rows(m) == before and m.revision == revision + 1
    jsonl.import_jsonl(m, "a.T", lines(spark, [{"n": 200, "k": None}]), key)
    assert not kept().refresh()["rebuilt"]
    kept().compact()
    again = kept().refresh()
    assert again["rematched"] == 0 and rows(m) == before


def test_retention_marks_releases_and_retires(spark, tmp_path):
    root = str(tmp_path)
    a, b, c, d, e = (fragments.put(spark, root, x.encode()) for x in "abcde")
    rows = [("1", a, True, None), ("1", a, True, None), ("2", b, False, None), ("3", c, None, datetime(2024, 3, 1)), ("4", d, False, None), ("5", e, False, None)]
    acquired = spark.createDataFrame(rows, "acquisition_id string, digest string, retention_required boolean, retain_until timestamp")
    # a cycle of b and d, reached from a; nulls lead nowhere
    refers = spark.createDataFrame([(a, b), (b, d), (d, b), (None, e), (e, None)], "holder string, digest string")
    roots = spark.createDataFrame([(None,)], "digest string")
    freed, gone = spark.createDataFrame([], retention.RELEASES), spark.createDataFrame([], retention.TOMBSTONES)
    now = lambda at: retention.states(acquired, freed, refers, roots, gone, at)
    seen = lambda at: {r["digest"]: (r["state"], r["n_holds"]) for r in now(at).collect()}
    assert seen("2024-01-01") == {a: ("held", 1), b: ("referenced", 0), c: ("held", 1), d: ("referenced", 0), e: ("expired", 0)}
    with pytest.raises(QueryValidationError):
        retention.release(acquired, freed, roots, gone, a, b, "why", "2024-01-02")
    with pytest.raises(FactloomError):
        retention.release(acquired, freed, spark.createDataFrame([(a,)], "digest string"), gone, a, a, "why", "2024-01-02")
    first = retention.plan(spark, root, now("2024-01-01"), "2024-01-01")
    freed = retention.release(acquired, freed, roots, gone, a, a, " done ", "2024-01-02")
    freed = retention.release(acquired, freed, roots, gone, a, a, "again", "2024-01-03")
    assert [tuple(r) for r in freed.select("acquisition_id", "reason").collect()] == [("1", "done")]
    assert {x for x, (s, _) in seen("2024-04-01").items() if s == "expired"} == {a, b, c, d, e}
    with pytest.raises(FactloomError):
        retention.retire(spark, root, first, "another", now("2024-01-01"), gone, "2024-01-04")
    gone = retention.retire(spark, root, first, first, now("2024-01-01"), gone, "2024-01-04")
    gone = retention.retire(spark, root, first, first, now("2024-01-01"), gone, "2024-01-05")
    assert [r["digest"] for r in gone.collect()] == [e] and seen("2024-01-04")[e] == ("retired", 0)
    second = retention.plan(spark, root, now("2024-04-01"), "2024-04-01")
    with pytest.raises(FactloomError):  # c is still held then
        retention.retire(spark, root, second, second, now("2024-01-06"), gone, "2024-01-06")
    assert {r["digest"]: r["status"] for r in fragments.audit(spark, root, acquired.select("digest").distinct()).collect()} == {a: "ok", b: "ok", c: "ok", d: "ok", e: "missing"}
    assert retention.states(*(t.limit(0) for t in (acquired, freed, refers, roots, gone)), "2024-01-01").count() == 0
