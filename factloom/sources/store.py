"""A memory in a file system: versioned Parquet folders and a small state file that names the current one.

All access goes through Hadoop's file systems, so a root may be any URI that Spark reads.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FactloomError
from ..memory import Entity, Field, Memory, Relation
from . import files


def save(memory: Memory, root: str) -> str:
    """Writes all tables as a new version and then points the state file at it. Readers of earlier
    versions are not disturbed."""
    spark = memory.spark
    if memory.generation.startswith("00000000"):
        memory.generation = str(uuid.uuid4())
    version = f"{root}/{memory.name}/v={memory.revision}-{uuid.uuid4().hex[:8]}"
    catalog = {"state": memory.state(), "entities": [], "relations": [], "imports": memory.imports, "runs": memory.runs, "namespaces": memory.namespaces, "writes": memory.writes, "provenance": [], "catalog": []}
    for i, e in enumerate(memory.entities.values()):
        e.df.write.parquet(f"{version}/entity-{i}")
        catalog["entities"].append({"name": e.name, "id_type": e.id_type, "path": f"entity-{i}", "fields": [f.__dict__ for f in e.fields.values()]})
    for i, r in enumerate(memory.relations):
        r.df.write.parquet(f"{version}/relation-{i}")
        catalog["relations"].append({"type": r.type, "logical_key": r.logical_key, "source_type": r.source_type, "target_type": r.target_type, "definition": r.definition, "path": f"relation-{i}"})
    for i, (entity, parts) in enumerate(memory.provenance.items()):
        functools.reduce(DataFrame.unionByName, parts).write.parquet(f"{version}/provenance-{i}")
        catalog["provenance"].append({"entity": entity, "path": f"provenance-{i}", "parts": len(parts)})
    for name, rows in memory.catalog.items():
        rows.write.parquet(f"{version}/catalog-{name}")
        catalog["catalog"].append(name)
    files.write(spark, f"{version}/catalog.json", json.dumps(catalog).encode())
    files.write(spark, f"{root}/{memory.name}/_state.json", json.dumps({"version": version.rpartition("/")[2], **memory.state()}).encode(), replace=True)
    return version


def load(spark: SparkSession, root: str, name: str = "default") -> Memory:
    """The memory at its current version; its tables stay those whatever is written later."""
    state = files.read_json(spark, f"{root}/{name}/_state.json")
    version = f"{root}/{name}/{state['version']}"
    catalog = files.read_json(spark, f"{version}/catalog.json")
    m = Memory(spark, name, state["generation"], state["data_revision"], imports=catalog["imports"], runs=catalog["runs"], namespaces=catalog["namespaces"], writes=catalog["writes"])
    for e in catalog["entities"]:
        m.entities[e["name"]] = Entity(e["name"], spark.read.parquet(f"{version}/{e['path']}"), {f["name"]: Field(**f) for f in e["fields"]}, e["id_type"])
    for r in catalog["relations"]:
        m.relations.append(Relation(r["type"], r["logical_key"], r["source_type"], r["target_type"], spark.read.parquet(f"{version}/{r['path']}"), r["definition"]))
    for p in catalog["provenance"]:
        rows = spark.read.parquet(f"{version}/{p['path']}")
        # A log of several writes stays one whose last write has to be found.
        m.provenance[p["entity"]] = [rows] if p["parts"] == 1 else [rows, rows.limit(0)]
    for c in catalog["catalog"]:
        m.catalog[c] = spark.read.parquet(f"{version}/catalog-{c}")
    return m


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order or partitioning."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    got = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{got['n']}:{got['s']}:{got['x']}"


def export_transfer(memory: Memory, root: str) -> dict:
    """Writes the memory to an empty place with a hash per table."""
    if files.exists(memory.spark, f"{root}/{memory.name}"):
        raise FactloomError("the target is not empty")
    version = save(memory, root)
    hashes = {e.name: table_hash(e.df) for e in memory.entities.values()} | {f"{r.type}/{r.logical_key}/{r.source_type}/{r.target_type}": table_hash(r.df) for r in memory.relations}
    files.write(memory.spark, f"{version}/hashes.json", json.dumps(hashes).encode())
    return hashes


def import_transfer(spark: SparkSession, root: str, name: str = "default") -> Memory:
    """Reads a transfer, checks every table's hash, and starts a new generation at revision 0."""
    m = load(spark, root, name)
    version = files.read_json(spark, f"{root}/{name}/_state.json")["version"]
    hashes = files.read_json(spark, f"{root}/{name}/{version}/hashes.json")
    for e in m.entities.values():
        if table_hash(e.df) != hashes[e.name]:
            raise FactloomError(f"table {e.name} differs from its hash")
    for r in m.relations:
        if table_hash(r.df) != hashes[f"{r.type}/{r.logical_key}/{r.source_type}/{r.target_type}"]:
            raise FactloomError(f"relation {r.type} differs from its hash")
    m.generation, m.revision = str(uuid.uuid4()), 0
    return m
