"""Where facts come from: a log beside the entity tables, with a row for each write of a field of a node.

An entity's log is a list of parts, one per write, each a DataFrame of id, field, seq (the write's number) and COLUMNS. Writes only
add a part; the last write of a field is found when somebody asks, for the fields and nodes asked for alone. So plans that don't ask
never scan a log, and an import pays nothing but a list of field names in the row it writes anyway.

Sources, fragments and objects are tables of the memory's catalog, joined by an explanation.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..memory import Memory

COLUMNS = {"source_id": "string", "batch_id": "string", "run_id": "string", "fragment_id": "string", "record": "long", "updated_at": "timestamp"}
CATALOG = {"sources": "source_id string, kind string, locator string", "fragments": "fragment_id string, digest string, selector string", "objects": "digest string, byte_size long, media_type string"}


def add(memory: Memory, entity: str, rows: DataFrame, fields: Column | None = None, **said) -> None:
    """One more part of an entity's log. rows: id, field and any of COLUMNS; or, with fields (an array of names), a row per node.
    said: the columns that all rows share, as values or columns."""
    unknown = set(said) - set(COLUMNS)
    if unknown:
        raise QueryValidationError(f"no provenance columns {sorted(unknown)}")
    memory.writes += 1
    each = rows.withColumn("field", F.explode(fields)) if fields is not None else rows
    cols = []
    for name, kind in COLUMNS.items():
        v = said.get(name, F.col(name) if name in rows.columns else None)
        cols.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    memory.provenance.setdefault(entity, []).append(each.select("id", "field", F.lit(memory.writes).cast("long").alias("seq"), *cols))


def latest(memory: Memory, entity: str, fields: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """id, field and COLUMNS of the last write of each field of each node: of the fields named, and of the nodes (column id) of a
    table, before any are compared."""
    parts = memory.provenance.get(entity)
    if not parts:
        kind = memory.entity(entity).id_type
        return memory.spark.createDataFrame([], f"id {kind}, field string, " + ", ".join(f"{n} {k}" for n, k in COLUMNS.items()))
    rows = functools.reduce(DataFrame.unionByName, parts)
    if fields is not None:
        rows = rows.filter(F.col("field").isin(fields))
    if of is not None:
        rows = rows.join(of.select("id").distinct(), "id", "left_semi")
    if len(parts) > 1:
        rows = rows.groupBy("id", "field").agg(F.max(F.struct("seq", *COLUMNS)).alias("w")).select("id", "field", *(F.col(f"w.{c}") for c in COLUMNS))
    return rows.select("id", "field", *COLUMNS)


def attribute_id(entity: str, node: Column, field: Column) -> Column:
    """The name of a node's field, the same in every run."""
    return F.sha2(F.to_json(F.array(F.lit(entity), node.cast("string"), field)), 256)


def project(memory: Memory, page: DataFrame, nodes: dict[str, str], returned: tuple[tuple[str, str], ...]) -> DataFrame:
    """A version 1 page (columns b_<alias>) with <alias>_<field>_<column> of each returned field, and its attribute id. The page is
    bounded, so the log is filtered by its nodes first."""
    for alias, name in returned:
        entity, key = nodes[alias], F.col(f"b_{alias}")
        nodes_of = page.select(key.alias("id"))
        there = latest(memory, entity, [name], nodes_of).drop("field")
        there = there.select(F.col("id").alias("_id"), *(F.col(c).alias(f"{alias}_{name}_{c}") for c in COLUMNS))
        page = page.join(there, key == F.col("_id"), "left").drop("_id")
        page = page.withColumn(f"{alias}_{name}_attribute_id", F.when(F.col(f"{alias}_{name}_present"), attribute_id(entity, key, F.lit(name))))
    return page


def catalog(memory: Memory, name: str) -> DataFrame:
    if name not in memory.catalog:
        return memory.spark.createDataFrame([], CATALOG[name])
    return memory.catalog[name]


def register(memory: Memory, name: str, rows: DataFrame) -> None:
    """Adds rows to one of the catalog's tables; a row that is there stays as it is."""
    if name not in CATALOG:
        raise QueryValidationError(f"no catalog table {name}")
    columns = [c.split()[0] for c in CATALOG[name].split(", ")]
    rows = rows.select(*columns)
    if name in memory.catalog:
        rows = memory.catalog[name].unionByName(rows.join(memory.catalog[name], columns[0], "left_anti"))
    memory.catalog[name] = rows


def explain(memory: Memory, entity: str, facts: DataFrame) -> DataFrame:
    """facts (id, field) with the value as text, the last write's COLUMNS, and what the catalog knows: source kind and locator,
    fragment selector, object digest and size. Facts that the memory doesn't hold are left out."""
    e = memory.entity(entity)
    texts = {f.name: F.col(f"c_{f.name}" if f.kind in ("number", "array", "object") else f"v_{f.name}").cast("string") for f in e.fields.values()}
    held = F.filter(F.array(*(F.when(F.col(f"p_{n}"), F.struct(F.lit(n).alias("field"), t.alias("value"))) for n, t in texts.items())), lambda x: x.isNotNull())
    values = e.df.select("id", F.explode(held).alias("x")).select("id", "x.field", "x.value")
    out = facts.select("id", "field").join(values, ["id", "field"]).join(latest(memory, entity, None, facts), ["id", "field"], "left")
    out = out.join(catalog(memory, "sources").select("source_id", F.col("kind").alias("source_kind"), F.col("locator").alias("source_locator")), "source_id", "left")
    out = out.join(catalog(memory, "fragments").select("fragment_id", "selector", F.col("digest").alias("object_digest")), "fragment_id", "left")
    out = out.join(catalog(memory, "objects").select(F.col("digest").alias("object_digest"), "byte_size"), "object_digest", "left")
    return out.withColumn("attribute_id", attribute_id(entity, F.col("id"), F.col("field")))


def dangling(memory: Memory, entity: str) -> DataFrame:
    """id, field, missing: facts whose last write names a source or fragment that the catalog doesn't have, or that has no write."""
    e = memory.entity(entity)
    names = F.filter(F.array(*(F.when(F.col(f"p_{f}"), F.lit(f)) for f in e.fields)), lambda x: x.isNotNull())
    facts = e.df.select("id", F.explode(names).alias("field")).join(latest(memory, entity), ["id", "field"], "left")
    s, f = catalog(memory, "sources").select("source_id", F.lit(1).alias("_s")), catalog(memory, "fragments").select("fragment_id", F.lit(1).alias("_f"))
    facts = facts.join(s, "source_id", "left").join(f, "fragment_id", "left")
    missing = F.when(F.col("updated_at").isNull(), "write").when(F.col("source_id").isNotNull() & F.col("_s").isNull(), "source").when(F.col("fragment_id").isNotNull() & F.col("_f").isNull(), "fragment")
    return facts.select("id", "field", missing.alias("missing")).filter("missing is not null")
