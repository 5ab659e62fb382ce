"""Version 2: optional branch, typed groups, exact measures, ratios, ordering and paging."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalyticsError, QueryValidationError
from ..functions.values import SAFE_INTEGER, as_integer, casefold, exact_ratio, ratio_sort_key
from ..memory import Memory
from .compile import V2, bindings, canon, fields_of, node_frame, node_id, predicate, present, value
from .ir import Measure, Query2
from .staging import written


def binding_frame(memory: Memory, q: Query2) -> DataFrame:
    """Matches of the base pattern, left-outer-joined with the optional branch, whose predicates run
    before the null extension. Its edge counts once however often it is stored."""
    base = bindings(memory, q.base, V2)
    if not q.optional:
        return base
    alias, edge = q.optional_alias, q.optional.edges[0]
    types = q.base.nodes | q.optional.nodes
    pairs = memory.edges(edge.type, types[edge.source], types[edge.target], edge.logical_key).distinct()
    own, mixed = F.lit(True), F.lit(True)
    for p in q.optional.where:
        cond = predicate(p, fields_of(memory, types, p), V2)
        own, mixed = (own & cond, mixed) if p.alias == alias else (own, mixed & cond)
    right = node_frame(memory, alias, q.optional.nodes[alias]).filter(own)
    near, far = ("target", "source") if edge.source == alias else ("source", "target")
    anchor = edge.target if edge.source == alias else edge.source
    right = right.join(pairs.select(F.col(near).alias("_near"), F.col(far).alias("_far")), node_id(alias) == F.col("_far")).drop("_far")
    return base.join(right, (node_id(anchor) == F.col("_near")) & mixed, "left").drop("_near")


def _when(q: Query2, m: Measure) -> Column:
    if m.when is None:
        return F.lit(True)
    bound = node_id(m.when[1]).isNotNull()
    return bound if m.when[0] == "bound" else ~bound


def _summed(memory: Memory, q: Query2, m: Measure) -> Column:
    alias, name = m.field
    types = q.base.nodes | (q.optional.nodes if q.optional else {})
    f = memory.entity(types[alias]).field(name)
    if f.json_type not in ("number", "unresolved"):
        raise QueryValidationError(f"sum over {f.json_type}")
    if f.kind == "unresolved":
        return F.lit(None).cast("decimal(38,0)")
    return as_integer(value(alias, name), value(alias, name) if f.kind == "long" else F.col(f"{alias}__i_{name}") if f.kind == "number" else None)


def _keys(memory: Memory, q: Query2) -> list[Column]:
    """kind and canonical value of each group: missing, null and value are different groups."""
    out = []
    for name, alias, f_name in q.groups:
        f = memory.entity(q.base.nodes[alias]).field(f_name)
        if f.kind in ("array", "object"):
            raise QueryValidationError("group_by needs a scalar field")
        filled = value(alias, f_name).isNotNull()
        out += [F.when(filled, "value").when(present(alias, f_name), "null").otherwise("missing").alias(f"{name}_kind"), canon(alias, f).alias(name)]
    return out


def _total(c: Column) -> Column:
    total = F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,0)"))
    return F.when(F.abs(total) <= SAFE_INTEGER, total).otherwise(F.raise_error(F.lit("analytics_error: sum outside the safe integers")).cast("decimal(38,0)")).cast("bigint")


def groups(memory: Memory, q: Query2, matches: DataFrame | None = None) -> DataFrame:
    """One row per group: <group>_kind, <group>, each measure, <sum>_skipped, each ratio. Global
    queries have one row even over nothing. matches: the query's binding_frame, if it is there already."""
    keys = _keys(memory, q)
    names = [n for g in q.groups for n in (f"{g[0]}_kind", g[0])]
    cols, plain = list(keys), {}
    aliases = list(q.base.nodes) + ([q.optional_alias] if q.optional_alias else [])
    cols += [node_id(a).alias(f"_n_{a}") for a in aliases]
    for m in q.measures:
        cols.append(_when(q, m).alias(f"_w_{m.name}"))
        if m.op == "sum":
            cols.append(_summed(memory, q, m).alias(f"_v_{m.name}"))
    rows = (binding_frame(memory, q) if matches is None else matches).select(*cols)

    distinct = [m for m in q.measures if m.op == "count_distinct" or m.distinct_on]
    owners = {m.node or m.distinct_on for m in distinct}

    def counted(m: Measure) -> Column:
        return F.col(f"_w_{m.name}") & F.col(f"_n_{m.node or m.field[0]}").isNotNull()

    if len(owners) == 1:
        # All distinct measures have one owner: once per (group, owner), then per group. No Expand.
        owner = owners.pop()
        first = []
        for m in q.measures:
            if m.op == "count_distinct":
                first.append(F.max(counted(m)).alias(m.name))
            elif m.op == "count":
                first.append(F.count_if(counted(m)).alias(m.name))
            elif m.distinct_on:
                first += [F.max(F.when(counted(m), F.col(f"_v_{m.name}"))).alias(m.name), F.max(counted(m) & F.col(f"_v_{m.name}").isNull()).alias(f"{m.name}_skipped")]
            else:
                first += [F.sum(F.when(counted(m), F.col(f"_v_{m.name}"))).alias(m.name), F.count_if(counted(m) & F.col(f"_v_{m.name}").isNull()).alias(f"{m.name}_skipped")]
        rows = rows.groupBy(*names, f"_n_{owner}").agg(*first)
        final = []
        for m in q.measures:
            if m.op == "count_distinct":
                final.append(F.count_if(m.name).alias(m.name))
            elif m.op == "count":
                final.append(F.coalesce(F.sum(m.name), F.lit(0)).alias(m.name))
            else:
                skipped = F.count_if(f"{m.name}_skipped") if m.distinct_on else F.coalesce(F.sum(f"{m.name}_skipped"), F.lit(0))
                final += [_total(F.col(m.name)).alias(m.name), skipped.alias(f"{m.name}_skipped")]
        out = rows.groupBy(*names).agg(*final)
    else:
        final = []
        for m in q.measures:
            if m.op == "count_distinct":
                final.append(F.countDistinct(F.when(counted(m), F.col(f"_n_{m.node}"))).alias(m.name))
            elif m.op == "count":
                final.append(F.count_if(counted(m)).alias(m.name))
            elif not m.distinct_on:
                final += [_total(F.when(counted(m), F.col(f"_v_{m.name}"))).alias(m.name), F.count_if(counted(m) & F.col(f"_v_{m.name}").isNull()).alias(f"{m.name}_skipped")]
            else:
                plain[m.name] = m
        out = rows.groupBy(*names).agg(*final) if final else rows.groupBy(*names).agg(F.count("*").alias("_rows"))
        for m in plain.values():
            once = rows.filter(counted(m)).groupBy(*names, f"_n_{m.distinct_on}").agg(F.max(f"_v_{m.name}").alias("v"))
            once = once.groupBy(*names).agg(_total(F.col("v")).alias(m.name), F.count_if(F.col("v").isNull()).alias(f"{m.name}_skipped"))
            if names:
                other = once.select(*(F.col(n).alias(f"_{n}") for n in names), m.name, f"{m.name}_skipped")
                cond = F.lit(True)
                for n in names:
                    cond = cond & F.col(n).eqNullSafe(F.col(f"_{n}"))
                out = out.join(other, cond, "left").drop(*(f"_{n}" for n in names))
            else:
                out = out.join(F.broadcast(once))  # one row each
            out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in (m.name, f"{m.name}_skipped")})
    for name, n, d in q.ratios:
        out = out.withColumn(name, exact_ratio(F.col(n), F.col(d)))
    keep = [*names, *(c for m in q.measures for c in ([m.name, f"{m.name}_skipped"] if m.op == "sum" else [m.name])), *(r[0] for r in q.ratios)]
    return out.select(*keep)


def group_id(q: Query2, population: str = "") -> Column:
    """Hash of the typed key and the population that the group belongs to, as canonical JSON."""
    parts = [F.struct(F.col(f"{g[0]}_kind").alias("kind"), F.lit(g[0]).alias("name"), F.col(g[0]).alias("value")) for g in q.groups]
    key = F.array(*parts) if parts else F.array().cast("array<string>")
    return F.sha2(F.to_json(F.struct(key.alias("group_key"), F.lit(population).alias("population_hash")), {"ignoreNullFields": "false"}), 256)


def identified(memory: Memory, q: Query2, population: str) -> DataFrame:
    """groups() with the group_id of each."""
    return groups(memory, q).withColumn("group_id", group_id(q, population))


def ordered(memory: Memory, q: Query2, out: DataFrame) -> DataFrame:
    """Values before null before missing, null ratios last, in both directions; ties by group id."""
    ratios = {r[0]: r for r in q.ratios}
    fields = {g[0]: memory.entity(q.base.nodes[g[1]]).field(g[2]) for g in q.groups}
    keys = []
    for name, direction in q.order:
        if name in ratios:
            _, n, d = ratios[name]
            cols = [ratio_sort_key(F.col(n), F.col(d))]
            keys.append(F.col(name).isNull().asc())
        elif name in fields:
            f = fields[name]
            keys.append(F.when(F.col(f"{name}_kind") == "value", 0).when(F.col(f"{name}_kind") == "null", 1).otherwise(2).asc())
            cols = [casefold(F.col(name), f.ascii), F.col(name)] if f.kind == "string" else [F.col(name).cast("double"), F.col(name)] if f.json_type == "number" else [F.col(name)]
        else:
            cols = [F.col(name)]
        keys += [c.asc() if direction == "asc" else c.desc() for c in cols]
    return out.orderBy(*keys, group_id(q).asc())


def run_v2(memory: Memory, q: Query2, matches: DataFrame | None = None) -> DataFrame:
    """A page of groups, in order."""
    out = ordered(memory, q, groups(memory, q, matches))
    return (out.offset(q.offset) if q.offset else out).limit(q.limit)


def execute_v2(memory: Memory, q: Query2) -> dict:
    """A page with the totals that tell whether it is cut. The groups are aggregated once, into a written table."""
    every = written(groups(memory, q), "groups")
    total = every.count() if q.groups else 1
    page = ordered(memory, q, every)
    rows = (page.offset(q.offset) if q.offset else page).limit(q.limit).collect()
    return {"groups": [r.asDict() for r in rows], "total_groups": total, "truncated": q.offset + q.limit < total, "complete_input": True, "state": memory.state()}


# -- bundles and drill-down -------------------------------------------------------------------------


def check_bundle(memory: Memory, members: dict[str, Query2], coverage: dict[str, tuple[str, str]] | None = None, expected_state: dict | None = None) -> None:
    """Raises where a bundle has too many members, isn't of the expected state, or a coverage role names no measure of an unpaged global member."""
    from ..errors import StaleResultError
    from .ir import MAX_MEMBERS

    if not 1 <= len(members) <= MAX_MEMBERS:
        raise QueryValidationError("1 to 16 members")
    if expected_state is not None and expected_state != memory.state():
        raise StaleResultError("the memory has changed; refresh and run again")
    for role, (member, measure) in (coverage or {}).items():
        q = members.get(member)
        if q is None or q.groups or q.offset or measure not in [m.name for m in q.measures]:
            raise QueryValidationError(f"coverage role {role} needs a measure of a global member")


def execute_bundle(memory: Memory, members: dict[str, Query2], coverage: dict[str, tuple[str, str]] | None = None, expected_state: dict | None = None) -> dict[str, DataFrame]:
    """Named members over one pinned state; members of one pattern share its matches."""
    check_bundle(memory, members, coverage, expected_state)
    matches = shared_matches(memory, members)
    return {name: run_v2(memory, q, matches.get(name)) for name, q in members.items()}


def fields_read(q: Query2) -> dict[str, set[str]]:
    """Fields that a query reads, by alias."""
    out: dict[str, set[str]] = {a: set() for a in [*q.base.nodes, *(q.optional.nodes if q.optional else ())]}
    for pattern in (q.base, q.optional):
        for p in pattern.where if pattern else ():
            out[p.alias].add(p.field)
    for _, alias, name in q.groups:
        out[alias].add(name)
    for m in q.measures:
        if m.field:
            out[m.field[0]].add(m.field[1])
    return out


def shared_matches(memory: Memory, members: dict[str, Query2], alone: bool = False) -> dict[str, DataFrame]:
    """The bindings of members that share their pattern with another: matched once, without the base's predicates, and written with the
    columns that any of them reads; each member filters that table. What is in the optional branch has to be the same. alone: those of a
    member that shares its pattern with none too, with its predicates."""
    alike: dict[str, list[str]] = {}
    for name, q in members.items():
        alike.setdefault(repr((sorted(q.base.nodes.items()), q.base.edges, q.optional, q.optional_alias)), []).append(name)
    out = {}
    for names in alike.values():
        if len(names) < 2 and not alone:
            continue
        first, several = members[names[0]], len(names) > 1
        rows = binding_frame(memory, replace(first, base=replace(first.base, where=())) if several else first)
        wanted = {f"{a}__{c}_{f}" for n in names for a, fs in fields_read(members[n]).items() for f in fs for c in "vpci"}
        rows = written(rows.select(*(c for c in rows.columns if c.endswith("__id") or c in wanted)), "matches")
        for n in names:
            q, own = members[n], rows
            for p in q.base.where if several else ():
                own = own.filter(predicate(p, fields_of(memory, q.base.nodes, p), V2))
            out[n] = own
    return out


def coverage_frame(memory: Memory, members: dict[str, Query2], coverage: dict[str, tuple[str, str]]) -> DataFrame:
    """role, value: one row per coverage role."""
    check_bundle(memory, members, coverage)
    out, used = None, {member: members[member] for member, _ in coverage.values()}
    matches = shared_matches(memory, used)
    for role, (member, measure) in coverage.items():
        one = groups(memory, members[member], matches.get(member)).select(F.lit(role).alias("role"), F.col(measure).cast("bigint").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def group_bindings(memory: Memory, q: Query2, key: dict[str, tuple]) -> DataFrame:
    """The bindings of one group, picked by its exact typed key: {name: (kind, value)}."""
    rows = binding_frame(memory, q)
    for (name, _, _), kind, text in zip(q.groups, _keys(memory, q)[::2], _keys(memory, q)[1::2], strict=True):
        want = key[name]
        rows = rows.filter(kind == want[0])
        if want[0] == "value":
            rows = rows.filter(text == want[1])
    return rows


def drill(memory: Memory, q: Query2, key: dict[str, tuple], view: str, result: str | None = None) -> DataFrame:
    """What lies under a group. bindings: node ids of every match; counted_entities: each entity that a
    measure counts with its number of bindings; contributions: value and occurrences per owner of a sum;
    numerator and denominator: counted entities of a ratio's parts."""
    rows = group_bindings(memory, q, key)
    aliases = list(q.base.nodes) + ([q.optional_alias] if q.optional_alias else [])
    if view == "bindings":
        return rows.select(*(node_id(a).alias(a) for a in aliases))
    if view in ("numerator", "denominator"):
        ratio = next(r for r in q.ratios if r[0] == result)
        result = ratio[1] if view == "numerator" else ratio[2]
    m = next((m for m in q.measures if m.name == result), None)
    if m is None:
        raise AnalyticsError(f"unknown measure {result}")
    owner = m.node or m.field[0]
    used = rows.filter(_when(q, m) & node_id(owner).isNotNull())
    aggs = [F.count("*").alias("occurrences")]
    if m.op == "sum":
        aggs.insert(0, F.max(_summed(memory, q, m)).cast("bigint").alias("value"))
    return used.groupBy(node_id(owner).alias("node_id")).agg(*aggs)


def membership(memory: Memory, q: Query2) -> DataFrame:
    """The typed key's columns, measure, node_id, bindings: which nodes count for each measure of each group, and in how many
    of its bindings. A sum counts the nodes that have a value. What a capture keeps."""
    rows, keys, out = binding_frame(memory, q), _keys(memory, q), None
    names = [n for g in q.groups for n in (f"{g[0]}_kind", g[0])]
    for m in q.measures:
        owner = m.node or m.field[0]
        used = rows.filter(_when(q, m) & node_id(owner).isNotNull())
        if m.op == "sum":
            used = used.filter(_summed(memory, q, m).isNotNull())
        one = used.groupBy(*(k.alias(n) for k, n in zip(keys, names)), node_id(owner).cast("string").alias("node_id")).agg(F.count("*").alias("bindings"))
        one = one.select(*names, F.lit(m.name).alias("measure"), "node_id", "bindings")
        out = one if out is None else out.unionByName(one)
    return out


def drill_page(memory: Memory, q: Query2, key: dict[str, tuple], view: str, result: str | None = None, offset: int = 0, limit: int = 100) -> dict:
    """A page of drill() with total_members, truncated and the reconciliation of the measure: its bindings,
    distinct entities and, for a sum, what the contributions add up to. A key that no group has is an error."""
    if offset < 0 or not 1 <= limit <= 1000:
        raise QueryValidationError("invalid drill-down page")
    if q.groups and group_bindings(memory, q, key).isEmpty():
        raise QueryValidationError("no group has this key")
    rows = written(drill(memory, q, key, view, result), "drill")
    total = rows.count()
    page = rows.orderBy(*rows.columns)
    out = {"view": view, "measure": result, "rows": [r.asDict() for r in (page.offset(offset) if offset else page).limit(limit).collect()], "total_members": total, "truncated": offset + limit < total}
    if "occurrences" in rows.columns:
        sums = [F.sum(F.col("value") * (1 if _distinct(q, result) else F.col("occurrences"))).alias("sum_contributions")] if "value" in rows.columns else []
        out["reconciliation"] = rows.agg(F.sum("occurrences").alias("binding_count"), F.count("*").alias("distinct_entities"), *sums).first().asDict()
    return out


def _distinct(q: Query2, result: str | None) -> bool:
    return any(m.name == result and m.distinct_on for m in q.measures)


def compact_drill(memory: Memory, entity: str, rows: DataFrame) -> DataFrame:
    """rows (node_id, ...) with the node's privacy and its present attributes, values alone: a map of field to text."""
    e = memory.entity(entity)
    pairs = [F.when(F.col(f"p_{f}"), F.struct(F.lit(f).alias("k"), F.col(f"v_{f}").cast("string").alias("v"))) for f in e.fields]
    values = e.df.select(F.col("id").alias("node_id"), "privacy", F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("attributes"))
    return rows.join(values, "node_id")
