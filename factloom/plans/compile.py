"""Patterns and predicates as DataFrame plans. Nothing is ordered by hand: equi-joins, filters and
projections are declared and Catalyst plans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..functions.values import canonical_json, casefold, json_type
from ..memory import Field, Memory
from .ir import ORDERED, Pattern, Predicate, Query1
from .staging import written

V1, V2 = 1, 2


def value(alias: str, name: str) -> Column:
    return F.col(f"{alias}__v_{name}")


def present(alias: str, name: str) -> Column:
    return F.coalesce(F.col(f"{alias}__p_{name}"), F.lit(False))


def node_id(alias: str) -> Column:
    return F.col(f"{alias}__id")


def canon(alias: str, f: Field) -> Column:
    """Canonical JSON text of a field's value; null for null and missing."""
    v = value(alias, f.name)
    if f.kind in ("number", "array", "object"):
        return F.col(f"{alias}__c_{f.name}")
    if f.kind == "string":
        return v
    return v.cast("string")


def _literal(v, kind: str):
    """Whether a literal can be compared natively with a field of this kind, and as what."""
    if kind == "long" and isinstance(v, int):
        return F.lit(v) if abs(v) < 2**63 else None
    if kind == "double" and isinstance(v, float):
        return F.lit(v)
    return F.lit(v) if kind in ("string", "boolean") else None


def equals(alias: str, f: Field, v) -> Column:
    """Textual equality of canonical JSON: 1 is not 1.0. The value's own type lets scans push it down."""
    if v is None:
        return present(alias, f.name) & value(alias, f.name).isNull() & (F.col(f"{alias}__c_{f.name}").isNull() if f.kind in ("number", "array", "object") else F.lit(True))
    native = _literal(v, f.kind)
    if native is not None:
        return F.coalesce(value(alias, f.name) == native, F.lit(False))
    if f.kind in ("number", "array", "object"):
        return F.coalesce(F.col(f"{alias}__c_{f.name}") == canonical_json(v), F.lit(False))
    return F.lit(False)


def check_literal(f: Field, p: Predicate) -> None:
    for v in p.values:
        if v is not None and f.kind != "unresolved" and json_type(v) != f.json_type:
            raise QueryValidationError(f"{p.alias}.{p.field} is {f.json_type}, not {json_type(v)}")
    if p.op in ORDERED and f.json_type in ("boolean", "array", "object"):
        raise QueryValidationError(f"{p.op} on {f.json_type}")


def predicate(p: Predicate, f: Field, dialect: int) -> Column:
    check_literal(f, p)
    there = present(p.alias, f.name)
    if p.op == "exists":
        return there
    if f.kind == "unresolved":
        # Only nulls were ever seen: version 1 matches nothing, version 2 matches an explicit null.
        return there if dialect == V2 and (p.op == "eq" or p.op == "in") and None in p.values else F.lit(False)
    if p.op in ("eq", "in"):
        out = F.lit(False)
        natives = [_literal(v, f.kind) for v in p.values]
        if None not in p.values and all(n is not None for n in natives):
            return F.coalesce(value(p.alias, f.name).isin(list(p.values)), F.lit(False)) if len(natives) > 1 else equals(p.alias, f, p.values[0])
        for v in p.values:
            out = out | equals(p.alias, f, v)
        return out
    v = p.values[0]
    if p.op == "ne":
        if dialect == V1:
            return there & ~equals(p.alias, f, v)
        filled = there & ~equals(p.alias, f, None)
        return filled & ~equals(p.alias, f, v) if v is not None else F.lit(False)
    if v is None:
        return F.lit(False)
    left, right = value(p.alias, f.name), F.lit(v)
    if f.json_type == "number":
        if dialect == V1:
            left, right = left.cast("double"), F.lit(float(v))
        elif f.kind == "long":
            right = F.lit(v) if isinstance(v, int) else F.lit(v).cast("double")
        elif f.kind == "number":
            return F.coalesce(_exact_number(p, f, v), F.lit(False))
    elif dialect == V1:
        left, right = F.struct(casefold(left, f.ascii).alias("fold"), left.alias("exact")), F.struct(F.lit(v.casefold()).alias("fold"), F.lit(v).alias("exact"))
        return F.coalesce(value(p.alias, f.name).isNotNull() & _compare(left, p.op, right), F.lit(False))
    return F.coalesce(_compare(left, p.op, right), F.lit(False))


def _exact_number(p: Predicate, f: Field, v) -> Column:
    whole, real = F.col(f"{p.alias}__i_{f.name}"), value(p.alias, f.name)
    if isinstance(v, int) and abs(v) < 10**38:
        return F.when(whole.isNotNull(), _compare(whole, p.op, F.lit(str(v)).cast("decimal(38,0)"))).otherwise(_compare(real, p.op, F.lit(float(v))))
    return _compare(real, p.op, F.lit(float(v)))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op]


def node_frame(memory: Memory, alias: str, entity: str) -> DataFrame:
    """All columns of an entity under the alias; unused ones are pruned from the scan."""
    df = memory.entity(entity).df
    return df.select(*(F.col(c).alias(f"{alias}__{c}") for c in df.columns))


def fields_of(memory: Memory, nodes: dict[str, str], p: Predicate) -> Field:
    return memory.entity(nodes[p.alias]).field(p.field)


def bindings(memory: Memory, pattern: Pattern, dialect: int) -> DataFrame:
    """One row per match: each alias's columns. Two aliases may bind the same node; parallel edges multiply rows."""
    where = {a: F.lit(True) for a in pattern.nodes}
    for p in pattern.where:
        where[p.alias] = where[p.alias] & predicate(p, fields_of(memory, pattern.nodes, p), dialect)
    frames = {a: node_frame(memory, a, t).filter(where[a]) for a, t in pattern.nodes.items()}
    first = next(iter(pattern.nodes))
    out, bound, todo = frames[first], {first}, list(pattern.edges)
    while todo:
        e = next((e for e in todo if e.source in bound or e.target in bound), None)
        if e is None:
            raise QueryValidationError("disconnected pattern")
        todo.remove(e)
        edges = memory.edges(e.type, pattern.nodes[e.source], pattern.nodes[e.target], e.logical_key)
        edges = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
        if e.source in bound and e.target in bound:
            out = out.join(edges, (node_id(e.source) == F.col("_s")) & (node_id(e.target) == F.col("_t"))).drop("_s", "_t")
            continue
        new, at, to = (e.target, "_s", "_t") if e.source in bound else (e.source, "_t", "_s")
        old = e.source if e.source in bound else e.target
        out = out.join(edges, node_id(old) == F.col(at)).join(frames[new], node_id(new) == F.col(to)).drop("_s", "_t")
        bound.add(new)
    return out


def order_columns(alias: str, f: Field, direction: str) -> list[Column]:
    """Present before missing in both directions; strings by (casefold, code points), numbers as doubles."""
    v = value(alias, f.name)
    if f.kind == "string":
        keys = [casefold(v, f.ascii), v]
    elif f.json_type == "number":
        keys = [v.cast("double")]
    else:
        keys = [canon(alias, f)]
    return [present(alias, f.name).desc(), *(k.asc_nulls_first() if direction == "asc" else k.desc_nulls_last() for k in keys)]


def run_v1(memory: Memory, q: Query1, provenance: bool = False) -> DataFrame:
    """Count: one row `count`. Else node ids b_<alias> and, per returned field, its value, whether it is
    present, and its JSON type; ordered and paged (limit + 1 rows tell that the page is cut). provenance: with
    the last write of each returned field, joined to the page alone, in the page's order."""
    rows = bindings(memory, q.pattern, V1)
    if q.count:
        return rows.agg(F.count("*").alias("count"))
    cols = [node_id(a).alias(f"b_{a}") for a in q.pattern.nodes]
    for alias, name in q.returns:
        f = memory.entity(q.pattern.nodes[alias]).field(name)
        cols += [value(alias, name).alias(f"{alias}_{name}"), present(alias, name).alias(f"{alias}_{name}_present")]
        if f.kind == "number":
            cols.append(F.col(f"{alias}__c_{name}").alias(f"{alias}_{name}_text"))
    order = []
    for alias, name, direction in q.order:
        order += order_columns(alias, memory.entity(q.pattern.nodes[alias]).field(name), direction)
    order += [node_id(a).asc() for a in q.pattern.nodes]
    if provenance:
        from ..operators.provenance import project

        page = rows.orderBy(*order).offset(q.offset).limit(q.limit + 1).select(*cols, F.monotonically_increasing_id().alias("_at"))
        return project(memory, written(page, "page"), q.pattern.nodes, q.returns).orderBy("_at").drop("_at")
    return rows.orderBy(*order).offset(q.offset).limit(q.limit + 1).select(*cols) if q.offset else rows.orderBy(*order).limit(q.limit + 1).select(*cols)


def page(rows: list, limit: int) -> dict:
    """Collected rows of a page and whether it was cut."""
    return {"rows": rows[:limit], "truncated": len(rows) > limit}
