"""Materialised joins and their diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import JoinError, QueryValidationError
from ..memory import Entity, Field, Memory
from ..plans.compile import V2, node_frame, predicate
from ..plans.ir import Predicate
from ..plans.staging import written


def _parts(e: Entity, fields: list[str], paired: list[Field]) -> list[Column]:
    """For each key field an array of its distinct non-null scalars; empty if missing, null or all null."""
    out = []
    for name, other in zip(fields, paired, strict=True):
        f = e.field(name)
        v = F.col(f"v_{name}")
        if f.kind == "unresolved" or other.kind == "unresolved":
            raise QueryValidationError("a join over an unresolved field")
        if f.kind == "array":
            out.append(_elements(F.col(f"c_{name}"), other))
        else:
            if f.json_type != other.json_type and other.kind != "array":
                raise QueryValidationError(f"join of {f.json_type} with {other.json_type}")
            if f.kind == "number":
                v = F.col(f"c_{name}")
            out.append(F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast(f"array<{'string' if f.kind == 'number' else {'long': 'bigint'}.get(f.kind, f.kind)}>")))
    return out


#: JSON type of an array's element by what Spark's variant says of it; null elements are VOID.
_ELEMENT = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
_STORED = {"long": "bigint", "double": "double", "boolean": "boolean"}


def _elements(array: Column, other: Field) -> Column:
    """Distinct non-null elements of a JSON array, as the paired field stores its values. An element that is no scalar, or of another
    JSON type than the field, raises: 5 is not "5"."""
    kinds = F.transform(F.from_json(array, "array<variant>"), F.schema_of_variant)
    nested = F.exists(kinds, lambda k: k.rlike("^(OBJECT|ARRAY)"))
    named = F.transform(kinds, lambda k: F.coalesce(*(F.when(k == v, j) for v, j in _ELEMENT.items()), F.lit("number")))
    alien = F.exists(named, lambda k: ~k.isin("null", other.json_type))
    texts = F.from_json(array, "array<string>")
    texts = F.when(nested, F.raise_error(F.lit("join arrays require scalar elements")).cast("array<string>")).when(
        alien, F.raise_error(F.lit("join array elements have incompatible types")).cast("array<string>")).otherwise(texts)
    if other.kind == "double":  # equality is textual: 5 is not 5.0
        texts = F.filter(texts, lambda x: x.rlike("[.eE]"))
    to = _STORED.get(other.kind, "string")
    items = F.transform(texts, lambda x: x.try_cast(to)) if to != "string" else texts
    return F.coalesce(F.array_distinct(F.array_compact(items)), F.array().cast(f"array<{to}>"))


def key_rows(e: Entity, fields: list[str], paired: list[Field], prefix: str, *more: Column) -> DataFrame:
    """<prefix>id, more and one row per key tuple: k0, k1, ... (the product of the fields' elements)."""
    df = e.df.select(F.col("id").alias(f"{prefix}id"), *more, *(p.alias(f"_a{i}") for i, p in enumerate(_parts(e, fields, paired))))
    for i in range(len(fields)):
        df = df.select(*[c for c in df.columns if c != f"_a{i}"], F.explode(f"_a{i}").alias(f"{prefix}k{i}"))
    return df


def key_lists(e: Entity, fields: list[str], paired: list[Field], *more: Column) -> DataFrame:
    """id, more and keys, all key tuples of a row as arrays of texts (see key_texts): no row is made more than one."""
    df = e.df.select("id", *more, *(p.alias(f"_a{i}") for i, p in enumerate(_parts(e, fields, paired))))
    keys = F.array(F.array().cast("array<string>"))
    for i in range(len(fields)):
        double = df.schema[f"_a{i}"].dataType.elementType.simpleString() == "double"
        texts = F.transform(f"_a{i}", lambda x: (x + F.lit(0.0) if double else x).cast("string"))  # noqa: B023
        keys = F.flatten(F.transform(keys, lambda k: F.transform(texts, lambda x: F.concat(k, F.array(x)))))  # noqa: B023
    return df.select(*(c for c in df.columns if not re.fullmatch(r"_a\d+", c)), F.array_distinct(keys).alias("keys"))


def single(e: Entity, fields: list[str]) -> bool:
    """Whether a row has at most one key tuple."""
    return all(e.field(f).kind != "array" for f in fields)


def _setup(memory: Memory, definition: dict):
    source, target = memory.entity(definition["from"]["type"]), memory.entity(definition["to"]["type"])
    sf, tf = definition["from"]["fields"], definition["to"]["fields"]
    if len(sf) != len(tf):
        raise QueryValidationError("a join pairs its fields")
    if any(target.field(f).kind in ("array", "object") for f in tf):
        raise QueryValidationError("target fields must be scalars")
    keys = key_rows(source, sf, [target.field(f) for f in tf], "s_", F.col("privacy").alias("s_privacy"))
    targets = key_rows(target, tf, [source.field(f) for f in sf], "t_", F.col("privacy").alias("t_privacy"))
    cond = F.lit(True)
    for i in range(len(sf)):
        cond = cond & (F.col(f"s_k{i}") == F.col(f"t_k{i}"))
    return source, target, keys, targets, cond


def key_texts(rows: DataFrame, prefix: str) -> Column:
    """A key tuple of key_rows as an array of texts; -0.0 is 0.0."""
    kinds = [(c, t) for c, t in rows.dtypes if c.startswith(f"{prefix}k")]
    return F.array(*((F.col(c) + F.lit(0.0) if t == "double" else F.col(c)).cast("string") for c, t in kinds))


def met(memory: Memory, definition: dict, texts: bool = False, by: dict[str, Column] | None = None) -> DataFrame:
    """A row per source: id, privacy, keys (its key tuples as texts; without texts only whether there are any), matched (the targets
    they hit) and, beside each, whether it is private. A source whose key has more than one target raises. by: columns of the id
    that the rows are dealt out by and keep. Ids and keys are shuffled once by the key, and where a source may have several rows or keys,
    once with the targets by the source; else they stay where the key brought them."""
    source, target, keys, targets, cond = _setup(memory, definition)
    tk = [c for c in targets.columns if c.startswith("t_k")]
    # Per key its only target; a key with more is an error only when a source hits it.
    index = targets.groupBy(*tk).agg(F.min("t_id").alias("t_id"), (F.min("t_id") != F.max("t_id")).alias("_many"), F.min("t_privacy").alias("t_privacy"))
    hit = F.when(F.col("_many"), F.raise_error(F.lit("ambiguous_target: multiple targets for a key")).cast(target.id_type)).otherwise(F.col("t_id"))
    hidden = F.coalesce((F.col("s_privacy") == "private") | (F.col("t_privacy") == "private"), F.lit(False))
    key = key_texts(keys, "s_") if texts else F.lit(True)
    hits = keys.join(index, cond, "left").select(F.col("s_id").alias("id"), F.col("s_privacy").alias("privacy"), key.alias("key"), hit.alias("target"), hidden.alias("hidden"))
    parts = _parts(source, definition["from"]["fields"], [target.field(f) for f in definition["to"]["fields"]])
    keyless = F.lit(False)
    for p in parts:
        keyless |= F.size(p) == 0
    # Sources without a key stay out of the join, where they would share a partition.
    rest = source.df.filter(keyless).select("id", "privacy", *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("key", "target", "hidden")))
    rows, by = hits.union(rest), by or {}
    if source.unique and single(source, definition["from"]["fields"]):
        some = lambda c: F.when(F.col("target" if c == "hidden" else c).isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{hits.schema[c].dataType.simpleString()}>"))
        return rows.select("id", "privacy", some("key").alias("keys"), some("target").alias("matched"), some("hidden").alias("hidden"), *(c.alias(n) for n, c in by.items()))
    if by:
        rows = rows.withColumns(by).repartition(*by)
    pair = F.when(F.col("target").isNotNull(), F.struct("target", "hidden"))
    rows = rows.groupBy(*by, "id").agg(F.min("privacy").alias("privacy"), F.collect_set("key").alias("keys"), F.collect_set(pair).alias("m"))
    return rows.select("id", "privacy", "keys", F.col("m.target").alias("matched"), F.col("m.hidden").alias("hidden"), *by)


def matched_edges(memory: Memory, definition: dict) -> DataFrame:
    """Distinct source, target of a join. A source whose key has more than one target raises."""
    return _pairs(met(memory, definition)).select("source", "target")


def _pairs(table: DataFrame) -> DataFrame:
    """source, target, privacy of met()."""
    rows = table.select(F.col("id").alias("source"), F.explode(F.arrays_zip("matched", "hidden")).alias("m"))
    return rows.select("source", F.col("m.matched").alias("target"), F.when(F.col("m.hidden"), "private").otherwise("public").alias("privacy"))


def materialize_join(memory: Memory, name: str, relation: str, definition: dict) -> DataFrame:
    """Adds the join's new edges (earlier ones stay, inactive ones stay inactive) and returns its counters:
    created, previously_active, previously_inactive, and the sources without an edge: skipped_null_or_missing
    (no whole key) and skipped_unmatched (keys, but no target for any of them)."""
    return keep(memory, name, relation, definition, written(met(memory, definition), "edges"))


def keep(memory: Memory, name: str, relation: str, definition: dict, table: DataFrame) -> DataFrame:
    """materialize_join() of a table of met() that lies somewhere: the new edges are read from it, as are the counters."""
    full = definition | {"relation": relation}
    earlier, pairs = memory.join_conflict(name, full), _pairs(table)
    source, target = definition["from"]["type"], definition["to"]["type"]
    keyed, hit = F.size("keys") > 0, F.size("matched")
    got = table.agg(F.count_if(~keyed).alias("skipped_null_or_missing"), F.count_if(keyed & (hit == 0)).alias("skipped_unmatched"), F.coalesce(F.sum(hit), F.lit(0)).alias("created")).first()
    found = {"created": got["created"], "previously_active": 0, "previously_inactive": 0}
    if earlier:
        state = written(pairs.join(earlier.df.select("source", "target", F.col("active").alias("_old")), ["source", "target"], "left"), "edges")
        found = state.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old")).alias("previously_active"), F.count_if(~F.col("_old")).alias("previously_inactive")).first().asDict()
        pairs = state.filter(F.col("_old").isNull())
    fresh = pairs.select("source", "target", F.lit(True).alias("active"), "privacy")
    if not earlier:
        memory.register_relation(relation, source, target, fresh, name, full)
    elif found["created"]:  # else no fact has changed
        memory.note(earlier.name, "upsert", fresh)
        memory.relations[memory.relations.index(earlier)] = type(earlier)(relation, name, source, target, earlier.df.unionByName(fresh), full)
        memory.revision += 1
    counters = found | {c: got[c] for c in ("skipped_null_or_missing", "skipped_unmatched")}
    return memory.spark.createDataFrame([tuple(counters.values())], ", ".join(f"{c} long" for c in counters))


REASONS = ("active_keys_disagree", "missing_or_null_key", "no_target", "linked", "inactive_relation", "eligible_not_materialized")


def inspect_relation(memory: Memory, name: str, source_where: tuple[Predicate, ...] = ()) -> DataFrame:
    """Per source: n_keys, target_ids, active_ids and the first reason that holds. Any target key with
    more than one target raises."""
    r = memory.declaration(name)
    source, target, keys, targets, cond = _setup(memory, r.definition)
    tk = [c for c in targets.columns if c.startswith("t_k")]
    many = F.when(F.min("t_id") != F.max("t_id"), F.raise_error(F.lit("ambiguous_target: multiple targets for a key")).cast(target.id_type)).otherwise(F.min("t_id"))
    index = targets.groupBy(*tk).agg(many.alias("t_id"))
    rows = node_frame(memory, "source", source.name)
    for p in source_where:
        rows = rows.filter(predicate(p, source.field(p.field), V2))
    rows = rows.select(F.col("source__id").alias("s_id"))
    found = keys.join(index, cond, "left").groupBy("s_id").agg(F.count("*").alias("n_keys"), F.collect_set("t_id").alias("target_ids"))
    edges = r.df.groupBy(F.col("source").alias("s_id")).agg(F.collect_set(F.when(F.col("active"), F.col("target"))).alias("active_ids"), F.collect_set(F.when(~F.col("active"), F.col("target"))).alias("inactive_ids"))
    none = F.array().cast(f"array<{target.id_type}>")
    out = rows.join(found, "s_id", "left").join(edges, "s_id", "left").select("s_id", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), *(F.array_sort(F.coalesce(c, none)).alias(c) for c in ("target_ids", "active_ids", "inactive_ids")))
    reason = (
        F.when(F.size(F.array_except("active_ids", "target_ids")) > 0, REASONS[0]).when(F.col("n_keys") == 0, REASONS[1]).when(F.size("target_ids") == 0, REASONS[2])
        .when(F.size(F.array_except("target_ids", "active_ids")) == 0, REASONS[3]).when(F.arrays_overlap("inactive_ids", "target_ids"), REASONS[4]).otherwise(REASONS[5])
    )
    return out.select(F.col("s_id").alias("source_id"), "n_keys", "target_ids", "active_ids", reason.alias("reason"))


def reason_histogram(inspection: DataFrame) -> DataFrame:
    return inspection.groupBy("reason").agg(F.count("*").alias("n_sources"), F.sum("n_keys").alias("n_keys"))


__all__ = ["JoinError", "inspect_relation", "keep", "matched_edges", "materialize_join", "met", "reason_histogram"]
