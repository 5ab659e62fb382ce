"""Query documents: validation and immutable plans. Version 1 is pattern, predicates and projection;
version 2 adds one optional branch, typed groups, exact measures and ratios."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import QueryValidationError

MAX_NODES = MAX_EDGES = MAX_GROUPS = 8
MAX_ROWS = 1000
MAX_MEMBERS = 16
ORDERED = ("lt", "lte", "gt", "gte")
OPERATORS = ("eq", "ne", *ORDERED, "in", "exists")


@dataclass(frozen=True)
class Edge:
    type: str
    source: str
    target: str
    logical_key: str | None = None


@dataclass(frozen=True)
class Predicate:
    alias: str
    field: str
    op: str
    values: tuple = ()


@dataclass(frozen=True)
class Pattern:
    nodes: dict[str, str]
    edges: tuple[Edge, ...]
    where: tuple[Predicate, ...]


@dataclass(frozen=True)
class Query1:
    pattern: Pattern
    returns: tuple[tuple[str, str], ...]
    order: tuple[tuple[str, str, str], ...]
    limit: int = 100
    offset: int = 0
    count: bool = False


@dataclass(frozen=True)
class Measure:
    name: str
    op: str
    node: str | None = None
    field: tuple[str, str] | None = None
    distinct_on: str | None = None
    when: tuple[str, str] | None = None


@dataclass(frozen=True)
class Query2:
    base: Pattern
    optional: Pattern | None
    optional_alias: str | None
    groups: tuple[tuple[str, str, str], ...]
    measures: tuple[Measure, ...]
    ratios: tuple[tuple[str, str, str], ...]
    order: tuple[tuple[str, str], ...]
    limit: int = 100
    offset: int = 0


def _need(ok, what: str) -> None:
    if not ok:
        raise QueryValidationError(what)


def _keys(d, allowed: set[str], what: str) -> None:
    _need(isinstance(d, dict) and set(d) <= allowed, f"{what}: unknown keys")


def _reference(text, nodes: dict[str, str]) -> tuple[str, str]:
    _need(isinstance(text, str) and "." in text, f"bad field reference {text!r}")
    alias, _, name = text.partition(".")
    _need(alias in nodes, f"unknown alias {alias}")
    return alias, name


def _predicates(items, nodes: dict[str, str]) -> tuple[Predicate, ...]:
    out = []
    for p in items:
        _keys(p, {"left", "op", "right"}, "predicate")
        alias, name = _reference(p["left"]["field"], nodes)
        op = p.get("op")
        _need(op in OPERATORS, f"unknown operator {op}")
        if op == "exists":
            _need("right" not in p, "exists takes no right operand")
            values = ()
        elif op == "in":
            _need(isinstance(p.get("right", {}).get("values"), list) and p["right"]["values"], "in needs a non-empty list")
            values = tuple(p["right"]["values"])
        else:
            _need(isinstance(p.get("right"), dict) and set(p["right"]) == {"value"}, f"{op} needs a value")
            values = (p["right"]["value"],)
        out.append(Predicate(alias, name, op, values))
    return tuple(out)


def _pattern(match, where, known: dict[str, str] | None = None) -> Pattern:
    _keys(match, {"nodes", "edges"}, "match")
    nodes: dict[str, str] = {}
    for n in match.get("nodes", []):
        _keys(n, {"type", "as"}, "node")
        _need(n["as"] not in nodes and n["as"] not in (known or {}), f"duplicate alias {n['as']}")
        nodes[n["as"]] = n["type"]
    every = (known or {}) | nodes
    _need(1 <= len(nodes) <= MAX_NODES, "1 to 8 nodes")
    edges = []
    for e in match.get("edges", []):
        _keys(e, {"type", "from", "to", "logical_key"}, "edge")
        _need(e["from"] in every and e["to"] in every, "edge between unknown aliases")
        _need(e.get("logical_key") != "", "empty logical_key")
        edges.append(Edge(e["type"], e["from"], e["to"], e.get("logical_key")))
    _need(len(edges) <= MAX_EDGES, "at most 8 edges")
    if known is None:
        reached, grew = {next(iter(nodes))}, True
        while grew:
            grew = False
            for e in edges:
                if (e.source in reached) != (e.target in reached):
                    reached |= {e.source, e.target}
                    grew = True
        _need(reached == set(nodes), "disconnected pattern")
    return Pattern(nodes, tuple(edges), _predicates(where, every))


def _page(doc) -> tuple[int, int]:
    limit, offset = doc.get("limit", 100), doc.get("offset", 0)
    _need(type(limit) is int and 1 <= limit <= MAX_ROWS, "limit is 1 to 1000")
    _need(type(offset) is int and offset >= 0, "offset is 0 or more")
    return limit, offset


def parse_v1(doc: dict) -> Query1:
    _keys(doc, {"query_ir_version", "match", "where", "return", "order_by", "limit", "offset"}, "query")
    _need(doc.get("query_ir_version") == "1", "query_ir_version must be 1")
    pattern = _pattern(doc["match"], doc.get("where", []))
    items = doc.get("return", [])
    _need(items, "return must not be empty")
    count = any("count" in i for i in items)
    _need(not count or items == [{"count": True}], "count is exclusive")
    returns = () if count else tuple(_reference(i["field"], pattern.nodes) for i in items)
    order = tuple((*_reference(o["field"], pattern.nodes), o.get("direction", "asc")) for o in doc.get("order_by", []))
    _need(all(d in ("asc", "desc") for *_, d in order), "direction is asc or desc")
    return Query1(pattern, returns, order, *_page(doc), count)


def parse_v2(doc: dict) -> Query2:
    _keys(doc, {"query_ir_version", "match", "where", "optional_match", "group_by", "measures", "derive", "order_by", "limit", "offset"}, "query")
    _need(doc.get("query_ir_version") == "2", "query_ir_version must be 2")
    base = _pattern(doc["match"], doc.get("where", []))
    optional, opt_alias = None, None
    branches = doc.get("optional_match", [])
    _need(len(branches) <= 1, "one optional branch at most")
    if branches:
        b = branches[0]
        _keys(b, {"nodes", "edges", "where"}, "optional_match")
        optional = _pattern({k: b[k] for k in ("nodes", "edges") if k in b}, b.get("where", []), base.nodes)
        _need(len(optional.nodes) == 1 and len(optional.edges) == 1, "an optional branch is one node and one edge")
        opt_alias = next(iter(optional.nodes))
        e = optional.edges[0]
        _need({e.source, e.target} - {opt_alias} <= set(base.nodes) and opt_alias in (e.source, e.target) and e.source != e.target, "the optional edge anchors at a base alias")
        _need(e.logical_key, "the optional edge needs a logical_key")
    every = base.nodes | (optional.nodes if optional else {})
    groups = tuple((g["as"], *_reference(g["field"], base.nodes)) for g in doc.get("group_by", []))
    _need(len(groups) <= MAX_GROUPS, "at most 8 groups")
    measures = []
    for m in doc.get("measures", []):
        _keys(m, {"as", "op", "node", "field", "distinct_on", "when"}, "measure")
        when = None
        if "when" in m:
            _need(len(m["when"]) == 1, "when is bound or unbound")
            (state, alias), = m["when"].items()
            _need(state in ("bound", "unbound") and alias == opt_alias, "when names the optional alias")
            when = (state, alias)
        _need(m["op"] in ("count", "count_distinct", "sum"), f"unknown measure {m['op']}")
        if m["op"] == "sum":
            ref = _reference(m["field"], every)
            _need(m.get("distinct_on") in (None, ref[0]), "distinct_on is the field's owner")
            measures.append(Measure(m["as"], "sum", None, ref, m.get("distinct_on"), when))
        else:
            _need(m.get("node") in every and "field" not in m, f"{m['op']} needs a node")
            measures.append(Measure(m["as"], m["op"], m["node"], None, None, when))
    _need(measures, "measures must not be empty")
    names = [m.name for m in measures]
    ratios = []
    for r in doc.get("derive", []):
        _need(r.get("op") == "ratio" and r["numerator"] in names and r["denominator"] in names, "ratio of two measures")
        _need(r.get("zero_denominator", "null") == "null", "zero_denominator is null")
        ratios.append((r["as"], r["numerator"], r["denominator"]))
    results = [g[0] for g in groups] + names + [r[0] for r in ratios]
    _need(len(set(results)) == len(results), "result names must be unique")
    order = tuple((o["result"], o.get("direction", "asc")) for o in doc.get("order_by", []))
    _need(all(n in results and d in ("asc", "desc") for n, d in order), "order_by names a result")
    return Query2(base, optional, opt_alias, groups, tuple(measures), tuple(ratios), order, *_page(doc))
