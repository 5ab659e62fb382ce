"""Captured observations: what a query gave on one state of a memory, kept with everything it was made of.

A capture is a folder named by its identity (members, definition, state). Each member has four Parquet tables: results (its groups), members
(which nodes count for each measure of each group, with the value of a sum), bindings (node ids of every match) and provenance (the last write of
each field that it reads, of each node in a binding). Tables are written and read by Spark, so neither the groups nor what lies under them
have a limit. Every file is a leaf of a digest tree: its SHA-256, a table's digest over its leaves, the manifest with the tables'
digests, and a digest of the manifest. A changed, missing or added file is found by comparing them.

Reading takes nothing from the memory, which may have changed since.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryValidationError, StaleResultError
from ..functions.values import canonical_json, sha256_json
from ..memory import Memory
from ..plans import aggregate
from ..plans.compile import node_id
from ..plans.ir import Query2, parse_v2
from ..sources import files
from . import provenance
from .lifecycle import freshness, population_hash

TABLES = ("results", "members", "bindings", "provenance")
METRICS = "metric_id string, observation string, definition_version string, member string, measure string, group_key string, dimensions_hash string, value string, origin string"


def _types(q: Query2) -> dict[str, str]:
    return q.base.nodes | (q.optional.nodes if q.optional else {})


def _keys(q: Query2) -> list[str]:
    return [n for g in q.groups for n in (f"{g[0]}_kind", g[0])]


def _members(memory: Memory, q: Query2, rows: DataFrame) -> DataFrame:
    """The typed key's columns, measure, node_id, occurrences, value: each node that a measure counts in the matches; a sum's has its value, or
    null where the sum skips it. Measures of one owner take one aggregation."""
    keys, owners, out = aggregate._keys(memory, q), {}, None
    for m in q.measures:
        owners.setdefault(m.node or m.field[0], []).append(m)
    for owner, measures in owners.items():
        aggs, each = [], []
        for i, m in enumerate(measures):
            used = aggregate._when(q, m)
            value = aggregate._summed(memory, q, m).cast("bigint") if m.op == "sum" else F.lit(None).cast("bigint")
            aggs += [F.count_if(used).alias(f"_n{i}"), F.max(F.when(used, value)).alias(f"_v{i}")]
            each.append(F.struct(F.lit(m.name).alias("measure"), F.col(f"_n{i}").alias("occurrences"), F.col(f"_v{i}").alias("value")))
        one = rows.filter(node_id(owner).isNotNull()).groupBy(*(k.alias(n) for k, n in zip(keys, _keys(q))), node_id(owner).cast("string").alias("node_id")).agg(*aggs)
        one = one.select(*_keys(q), "node_id", F.explode(F.array(*each)).alias("_x")).filter("_x.occurrences > 0").select(*_keys(q), "_x.measure", "node_id", "_x.occurrences", "_x.value")
        out = one if out is None else out.unionByName(one)
    return out


def _provenance(memory: Memory, q: Query2, bindings: DataFrame) -> DataFrame:
    """alias, node_id, field and the last write's columns, of the nodes in the bindings and the fields the query reads."""
    out = None
    for alias, names in aggregate.fields_read(q).items():
        entity = memory.entity(_types(q)[alias])
        nodes = bindings.select(F.col(alias).cast(entity.id_type).alias("id")).filter("id is not null")
        one = provenance.latest(memory, entity.name, sorted(names), nodes)
        one = one.select(F.lit(alias).alias("alias"), F.col("id").cast("string").alias("node_id"), "field", *provenance.COLUMNS)
        out = one if out is None else out.unionByName(one)
    return out


def _bindings(memory: Memory, q: Query2, rows: DataFrame) -> DataFrame:
    keys = [k.alias(n) for k, n in zip(aggregate._keys(memory, q), _keys(q))]
    return rows.select(*keys, *(node_id(a).cast("string").alias(a) for a in _types(q)))


def _public(memory: Memory, q: Query2, bindings: DataFrame) -> bool:
    """No private node in a binding, and no private field read."""
    for alias, names in aggregate.fields_read(q).items():
        entity = memory.entity(_types(q)[alias])
        if any(entity.field(n).privacy == "private" for n in names):
            return False
        private = entity.df.filter("privacy = 'private'").select(F.col("id").cast("string").alias(alias))
        if not bindings.select(alias).join(private, alias, "left_semi").isEmpty():
            return False
    return True


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    """member, name, file, digest of every data file of an observation."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return read.select(F.element_at(parts, -3).alias("member"), F.element_at(parts, -2).alias("name"), F.element_at(parts, -1).alias("file"), F.sha2("content", 256).alias("digest"))


def digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """The digest of each table (member/name) over its files' digests: as many rows as tables."""
    each = leaves(spark, folder).groupBy("member", "name").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "digest"))).alias("files"))
    return {f"{r['member']}/{r['name']}": r["digest"] for r in each.select("member", "name", F.sha2(F.array_join("files", "\n"), 256).alias("digest")).collect()}


def capture(memory: Memory, root: str, members: dict[str, dict], definition_version: str, expected_state: dict | None = None) -> dict:
    """Evaluates the members in full on the current state and keeps them. The same population, definition and state give the same
    observation; the memory's revision doesn't change."""
    if expected_state is not None and expected_state != memory.state():
        raise StaleResultError("the memory has changed; refresh and capture again")
    spark = memory.spark
    identity = sha256_json({"members": {n: population_hash(d) for n, d in members.items()}, "definition": definition_version, "state": memory.state()})
    folder = f"{root}/observations/{identity}"
    if files.exists(spark, f"{folder}/manifest.json"):
        return read(spark, root, identity, memory)
    files.delete(spark, folder)  # what a capture left that didn't end
    public, shape, queries = True, {}, {}
    for name, document in members.items():
        queries[name] = parse_v2({k: v for k, v in document.items() if k not in ("limit", "offset", "order_by")})
        if not name.isidentifier():
            raise QueryValidationError(f"bad member name {name!r}")
    # Each pattern is matched once, whatever number of tables and members is read from its matches.
    matches = aggregate.shared_matches(memory, queries, alone=True)
    for name, document in members.items():
        q, own = queries[name], matches[name]
        bindings = _bindings(memory, q, own)
        bindings.write.parquet(f"{folder}/{name}/bindings")
        bindings = spark.read.schema(bindings.schema).parquet(f"{folder}/{name}/bindings")
        tables = {"results": aggregate.groups(memory, q, own), "members": _members(memory, q, own), "provenance": _provenance(memory, q, bindings)}
        for table, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}/{table}")
        public = public and _public(memory, q, bindings)
        shape[name] = {"document": document, "aliases": _types(q), "keys": _keys(q), "ratios": [list(r) for r in q.ratios], "measures": [m.name for m in q.measures]}
    body = {"identity": identity, "definition_version": definition_version, "state": memory.state(), "members": shape, "fully_public": public, "tables": digests(spark, folder)}
    files.write(spark, f"{folder}/manifest.json", canonical_json({"digest": sha256_json(body), "body": body}).encode())
    return read(spark, root, identity, memory)


def read(spark: SparkSession, root: str, identity: str, memory: Memory | None = None) -> dict:
    """The manifest, checked against its digest; with a memory, how fresh it is."""
    kept = json.loads(files.read(spark, f"{root}/observations/{identity}/manifest.json"))
    if sha256_json(kept["body"]) != kept["digest"] or kept["body"]["identity"] != identity:
        raise StaleResultError("the observation is damaged")
    return kept["body"] | ({"freshness": freshness(memory, kept["body"]["state"])} if memory else {})


def damaged(spark: SparkSession, root: str, identity: str) -> list[str]:
    """Tables (member/name) whose files aren't those that the manifest knows."""
    want, have = read(spark, root, identity)["tables"], digests(spark, f"{root}/observations/{identity}")
    return sorted(t for t in want.keys() | have.keys() if want.get(t) != have.get(t))


def table(spark: SparkSession, root: str, identity: str, member: str, name: str) -> DataFrame:
    """One table of an observation; its files must be the manifest's."""
    manifest, folder = read(spark, root, identity), f"{root}/observations/{identity}"
    if member not in manifest["members"] or name not in TABLES:
        raise QueryValidationError(f"no table {member}/{name}")
    if digests(spark, f"{folder}/{member}/{name}") != {f"{member}/{name}": manifest["tables"].get(f"{member}/{name}")}:
        raise StaleResultError(f"{member}/{name} of the observation is damaged")
    return spark.read.parquet(f"{folder}/{member}/{name}")


def _of(rows: DataFrame, key: dict[str, tuple]) -> DataFrame:
    for name, (kind, *value) in key.items():
        rows = rows.filter(F.col(f"{name}_kind") == kind)
        if kind == "value":
            rows = rows.filter(F.col(name) == value[0])
    return rows


def drill(spark: SparkSession, root: str, identity: str, member: str, key: dict[str, tuple], view: str, result: str | None = None) -> DataFrame:
    """What lay under a group (by its exact typed key; every group for an empty key) when it was captured. bindings: node ids;
    counted_entities, numerator, denominator: node_id and occurrences; contributions: value too; provenance: the last
    write of each field read of the group's nodes."""
    about = read(spark, root, identity)["members"].get(member)
    if about is None:
        raise QueryValidationError(f"no member {member}")
    if view == "bindings":
        return _of(table(spark, root, identity, member, "bindings"), key)
    if view == "provenance":
        nodes = _of(table(spark, root, identity, member, "bindings"), key)
        pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("alias"), F.col(a).alias("node_id")) for a in about["aliases"])))
        nodes = nodes.select(pairs.alias("x")).select("x.alias", "x.node_id").distinct()
        return table(spark, root, identity, member, "provenance").join(nodes, ["alias", "node_id"], "left_semi")
    if view in ("numerator", "denominator"):
        ratio = next((r for r in about["ratios"] if r[0] == result), None)
        result = ratio and ratio[1 if view == "numerator" else 2]
    if result not in about["measures"]:
        raise QueryValidationError(f"no measure {result}")
    rows = _of(table(spark, root, identity, member, "members"), key).filter(F.col("measure") == result)
    return rows.select(*about["keys"], "node_id", "occurrences", *(["value"] if view == "contributions" else []))


def _group_key(about: dict) -> Column:
    parts = [F.struct(F.lit(k).alias("name"), F.col(f"{k}_kind").alias("kind"), F.col(k).alias("value")) for k in about["keys"][1::2]]
    return F.to_json(F.array(*parts), {"ignoreNullFields": "false"}) if parts else F.lit("[]")


def native_metrics(spark: SparkSession, root: str, identity: str) -> DataFrame:
    """METRICS of a captured observation: one row for each member, group and measure or ratio, read from its results."""
    manifest, out = read(spark, root, identity), None
    for member, about in manifest["members"].items():
        rows = table(spark, root, identity, member, "results")
        named = [c for c in rows.columns if c not in about["keys"] and not c.endswith("_skipped")]
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in named)))
        one = rows.select(_group_key(about).alias("group_key"), each.alias("x")).select(F.lit(member).alias("member"), "x.measure", "group_key", "x.value")
        out = one if out is None else out.unionByName(one)
    hashed = F.sha2(F.to_json(F.struct("member", "measure", "group_key")), 256)
    out = out.withColumn("dimensions_hash", hashed).withColumn("observation", F.lit(identity)).withColumn("definition_version", F.lit(manifest["definition_version"]))
    out = out.withColumn("metric_id", F.sha2(F.concat_ws(" ", "observation", "dimensions_hash"), 256)).withColumn("origin", F.lit("native"))
    return out.select(*(c.split()[0] for c in METRICS.split(", ")))
