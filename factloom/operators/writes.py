"""Computed values written back, namespace descriptions, retention plans, wiping, named memories."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FactloomError, ImportRejected, QueryValidationError
from ..functions.values import canonical_json, sha256_json, stable_uuid, strict_loads
from ..memory import SQL_TYPES, Field, Memory
from ..sources import files, store
from . import provenance


def write_attribute(memory: Memory, entity: str, name: str, kind: str, values: DataFrame, run: str, at: datetime | None = None) -> dict:
    """Writes a computed attribute: values has id and value, one row or many. Types are checked, absent
    nodes are an error, nodes without a row keep theirs. The same run and values are written once."""
    e = memory.entity(entity)
    known = e.fields.get(name)
    if known and known.kind not in (kind, "unresolved"):
        raise ImportRejected(f"{entity}.{name} is {known.json_type}")
    identity = sha256_json([run, entity, name, store.table_hash(values)])
    done = memory.runs
    if identity in done:
        return {"replayed": True}
    if values.join(e.df.select("id"), "id", "left_anti").limit(1).count():
        raise ImportRejected("a value for an unknown node")
    if values.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ImportRejected("two values for a node")
    f = replace(known, kind=kind) if known else Field(name, kind)
    new = values.select("id", F.lit(True).alias("_p"), *(c.alias(f"_{n}") for n, c in _stored(F.col("value"), kind).items()))
    rest = [c for c in e.df.columns if c[2:] != name or c[1] != "_"]
    cols = []
    for n in _stored(F.col("value"), kind):
        before = F.col(f"{n}_{name}") if known and known.kind == kind else F.lit(None)
        cols.append(F.when(F.col("_p"), F.col(f"_{n}")).otherwise(before).alias(f"{n}_{name}"))
    there = F.coalesce("_p", F.lit(False)) | (F.col(f"p_{name}") if known else F.lit(False))
    df = e.df.join(new, "id", "left").select(*rest, *cols, there.alias(f"p_{name}"))
    memory.entities[entity] = replace(e, df=df, fields=e.fields | {name: f})
    retyped = known is not None and known.kind != kind
    memory.note(entity, "full" if retyped else "upsert", None if retyped else df.join(values.select("id"), "id", "left_semi"))
    memory.revision += 1
    provenance.add(memory, entity, values.select("id", F.lit(name).alias("field")), run_id=run, updated_at=at or datetime.now(UTC))
    done[identity] = name
    return {"replayed": False}


@F.pandas_udf(T.StringType())
def _number_text(values: pd.Series) -> pd.Series:
    """Canonical JSON of numbers that came as their texts."""
    return values.map(lambda x: canonical_json(strict_loads(x)), na_action="ignore")


def _stored(value: Column, kind: str) -> dict[str, Column]:
    """The columns of an entity table that hold a value, by their letters (memory.py)."""
    if kind in ("array", "object"):
        text = _number_text(value.cast("string"))
        return {"v": text, "c": text}
    if kind == "number":
        shown = F.to_json(F.array(value))
        text = _number_text(F.when(value.isNotNull(), shown.substr(F.lit(2), F.length(shown) - 2)))
        whole = F.when(value == F.round(value), value.try_cast("decimal(38,0)"))
        return {"v": value.cast("double"), "c": text, "i": whole}
    return {"v": value.cast(SQL_TYPES[kind])}


METRICS = "metric_id string, run_id string, recorded_at timestamp, definition_version string, dimensions_hash string, numerator long, denominator long, value double, origin string, complete boolean, invalidated boolean"


def write_metric(metrics: DataFrame, run_id: str, recorded_at, definition_version: str, dimensions: dict, numerator: int, denominator: int, complete: bool = True) -> DataFrame:
    """metrics with one more observation; the same observation of a run is there once."""
    hashed = sha256_json(dimensions)
    metric_id = stable_uuid("metric", run_id, definition_version, hashed)
    if metrics.filter(F.col("metric_id") == metric_id).limit(1).count():
        return metrics
    value = numerator / denominator if denominator else None
    row = metrics.sparkSession.createDataFrame([(metric_id, run_id, recorded_at, definition_version, hashed, numerator, denominator, value, "caller", complete, False)], METRICS)
    return metrics.unionByName(row)


def declare_namespace(memory: Memory, namespace: str, description: str) -> bool:
    """Replaces a namespace's description; False if it already says so."""
    spaces = memory.namespaces
    if spaces.get(namespace) == description:
        return False
    spaces[namespace] = description
    memory.revision += 1
    return True


def compact_view(rows: DataFrame) -> DataFrame:
    """A version 1 page with values alone: no node ids, no presence flags."""
    return rows.select(*(c for c in rows.columns if not c.startswith("b_") and not c.endswith("_present")))


def retirable(evidence: DataFrame, as_of: str, manifests: DataFrame) -> DataFrame:
    """digest of the evidence objects that nothing holds at a time and no captured manifest names."""
    at = F.lit(as_of).cast("timestamp")
    held = F.col("retention_required") | F.coalesce(F.col("retain_until") > at, F.lit(False))
    per = evidence.groupBy("digest").agg(F.max("retired").alias("retired"), F.max(held).alias("held"))
    return per.filter(~F.col("retired") & ~F.col("held")).join(manifests.select("digest"), "digest", "left_anti").select("digest")


def plan_retirement(spark: SparkSession, digests: list[str], root: str, as_of: str) -> str:
    """An immutable plan, named by its hash, that has to be confirmed by this name."""
    plan = {"as_of": as_of, "digests": sorted(digests)}
    name = sha256_json(plan)
    files.write(spark, f"{root}/plans/{name}.json", canonical_json(plan).encode())
    return name


def retire(spark: SparkSession, root: str, plan: str) -> list[str]:
    """Deletes the objects of a plan, whose file must still have its hash; returns their digests."""
    body = files.read_json(spark, f"{root}/plans/{plan}.json")
    if sha256_json(body) != plan:
        raise FactloomError("the plan has changed")
    for d in body["digests"]:
        files.delete(spark, f"{root}/objects/sha256/{d[:2]}/{d}")
    return body["digests"]


def fingerprint(memory: Memory) -> dict:
    """Row counts and a hash over all tables: what a wipe has to be confirmed with."""
    hashes = {e.name: store.table_hash(e.df) for e in memory.entities.values()} | {f"{r.type}/{r.logical_key}": store.table_hash(r.df) for r in memory.relations}
    return {"counts": {n: int(h.split(":")[0]) for n, h in hashes.items()}, "hash": sha256_json(hashes)}


def wipe(memory: Memory, confirmed: dict) -> Memory:
    """An empty memory of a new generation, if confirmed is the memory's fingerprint."""
    if confirmed != fingerprint(memory):
        raise QueryValidationError("the confirmation differs from the memory")
    return Memory(memory.spark, memory.name, stable_uuid("generation", memory.generation, memory.revision), 0)


class Memories:
    """Named memories under one root; `default` is always there. Targets are disjoint directories."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def names(self) -> list[str]:
        found = [n for n in files.names(self.spark, self.root) if files.exists(self.spark, f"{self.root}/{n}/_state.json")]
        return sorted({"default", *found})

    def open(self, name: str = "default") -> Memory:
        if not name.isidentifier():
            raise QueryValidationError(f"bad memory name {name!r}")
        if files.exists(self.spark, f"{self.root}/{name}/_state.json"):
            return store.load(self.spark, self.root, name)
        return Memory(self.spark, name)

    def save(self, memory: Memory) -> None:
        store.save(memory, self.root)

    def destroy(self, name: str, confirmed: dict) -> None:
        if confirmed != fingerprint(self.open(name)):
            raise QueryValidationError("the confirmation differs from the memory")
        files.delete(self.spark, f"{self.root}/{name}")


def attribute_expression(memory: Memory, entity: str, value: Column) -> DataFrame:
    """id, value of an expression over an entity's columns, for write_attribute."""
    return memory.entity(entity).df.select("id", value.alias("value"))
