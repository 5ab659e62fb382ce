"""Finding F14 of round 3: how often a capture matches."""

from pyspark.sql import functions as F

from factloom.memory import Memory
from factloom.operators import observations
from factloom.plans import aggregate

MATCH = {
    "match": {"nodes": [{"type": "a.C", "as": "c"}]}, "group_by": [{"field": "c.kind", "as": "kind"}],
    "optional_match": [{"nodes": [{"type": "a.O", "as": "o"}], "edges": [{"type": "by", "from": "o", "to": "c", "logical_key": "k"}], "where": []}],
}
MEASURES = [{"as": "n", "op": "count_distinct", "node": "c"}, {"as": "hit", "op": "count_distinct", "node": "c", "when": {"bound": "o"}}, {"as": "o", "op": "count", "node": "o"}, {"as": "s", "op": "sum", "field": "c.x", "when": {"unbound": "o"}}]
ONE = {"query_ir_version": "2", "measures": MEASURES} | MATCH
SOME = ONE | {"where": [{"left": {"field": "c.kind"}, "op": "eq", "right": {"value": "a"}}]}


def test_a_capture_matches_each_pattern_once(spark, tmp_path, monkeypatch):
    """Before, each measure, the groups and the bindings of every member matched for themselves."""
    m = Memory(spark, "seen")
    rows = [(1, "a", 5), (2, "a", None), (3, None, 7), (4, "b", 9)]
    m.register_entity("a.C", spark.createDataFrame(rows, "id long, kind string, x long"), "id", {"kind": ("string", "kind"), "x": ("long", "x")})
    m.register_entity("a.O", spark.range(10, 14), "id", {"y": ("long", F.col("id"))})
    m.register_relation("by", "a.O", "a.C", spark.createDataFrame([(10, 1), (11, 1), (12, 4)], "source long, target long"), "k")
    calls, real = [], aggregate.binding_frame
    monkeypatch.setattr(aggregate, "binding_frame", lambda *a: calls.append(1) or real(*a))
    for members, times in (({"one": ONE, "some": SOME}, 1), ({"alone": SOME}, 1)):
        calls.clear()
        seen = observations.capture(m, str(tmp_path), members, "v1")
        assert len(calls) == times and seen["fully_public"]
        for name in members:
            got = observations.table(spark, str(tmp_path), seen["identity"], name, "members").select("kind", "measure", "node_id", "occurrences", "value")
            want = {("a", "n", "1", 2, None), ("a", "n", "2", 1, None), ("a", "hit", "1", 2, None), ("a", "o", "10", 1, None), ("a", "o", "11", 1, None), ("a", "s", "2", 1, None)}
            if name == "one":
                want |= {(None, "n", "3", 1, None), ("b", "n", "4", 1, None), ("b", "hit", "4", 1, None), ("b", "o", "12", 1, None), (None, "s", "3", 1, 7)}
            assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
            pairs = {tuple(r) for r in observations.table(spark, str(tmp_path), seen["identity"], name, "bindings").select("c", "o").collect()}
            assert pairs == {("1", "10"), ("1", "11"), ("2", None)} | ({("3", None), ("4", "12")} if name == "one" else set())
