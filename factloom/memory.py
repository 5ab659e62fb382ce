"""A memory: entities as wide typed tables, relations as edge tables, and the catalog of both.

An entity table has `id`, `privacy` and for each field its typed value `v_<field>` and whether the
attribute row exists, `p_<field>`: an explicit null is present without a value, a missing attribute
is not present. Fields of JSON numbers that mix integers and fractions, and of arrays and objects,
also have their canonical text `c_<field>`; numbers of that kind have an exact integer `i_<field>`.
Queries read only the columns they name, so parquet scans are pruned to them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import JoinError, QueryValidationError
from .functions.values import canonical_json, sha256_json
from .plans.bloom import Likely
from .plans.staging import written

#: JSON type of each storage kind.
JSON_TYPES = {"string": "string", "long": "number", "double": "number", "number": "number", "boolean": "boolean", "array": "array", "object": "object", "unresolved": "unresolved"}
SQL_TYPES = {"string": "string", "long": "bigint", "double": "double", "number": "double", "boolean": "boolean", "array": "string", "object": "string", "unresolved": "string"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    privacy: str = "public"
    searchable: bool = False
    required: bool = False
    nullable: bool = True
    ascii: bool = False
    description: str | None = None

    @property
    def json_type(self) -> str:
        return JSON_TYPES[self.kind]


@dataclass
class Entity:
    name: str
    df: DataFrame
    fields: dict[str, Field]
    id_type: str = "string"
    #: Whether each id surely stands in one row, as an import has checked.
    unique: bool = False

    def field(self, name: str) -> Field:
        if name not in self.fields:
            raise QueryValidationError(f"unknown field {self.name}.{name}")
        return self.fields[name]


@dataclass
class Relation:
    """Edges of one type, logical key and pair of entity types: source, target, active, privacy."""

    type: str
    logical_key: str | None
    source_type: str
    target_type: str
    df: DataFrame
    definition: dict | None = None

    @property
    def name(self) -> str:
        """What tells it from the memory's other relations."""
        return canonical_json([self.type, self.logical_key, self.source_type, self.target_type])


@dataclass
class Memory:
    spark: SparkSession
    name: str = "default"
    generation: str = "00000000-0000-0000-0000-000000000000"
    revision: int = 0
    entities: dict[str, Entity] = field(default_factory=dict)
    relations: list[Relation] = field(default_factory=list)
    #: What earlier calls returned, by their idempotency keys; kept with the memory.
    imports: dict[str, dict] = field(default_factory=dict)
    runs: dict = field(default_factory=dict)
    namespaces: dict[str, str | None] = field(default_factory=dict)
    #: Who wrote what: an entity's writes, and how many there were of all (operators/provenance.py).
    provenance: dict[str, list[DataFrame]] = field(default_factory=dict)
    catalog: dict[str, DataFrame] = field(default_factory=dict)
    writes: int = 0
    #: What a version store needs: the commit this was loaded from, its tables and stored parts, and what changed since by table.
    commit: int = 0
    #: The revision that was loaded or committed last.
    loaded: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    stored: list[tuple[DataFrame, str]] = field(default_factory=list)
    changes: dict[str, list[tuple[str, DataFrame | None]]] = field(default_factory=dict)

    def note(self, name: str, kind: str, rows: DataFrame | None = None) -> None:
        """A change of a table since the last commit: upsert (whole rows), delete (keys) or full."""
        self.changes.setdefault(name, []).append((kind, rows))

    def state(self) -> dict:
        return {"generation": self.generation, "data_revision": self.revision}

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise QueryValidationError(f"unknown entity type {name}")
        return self.entities[name]

    def register_entity(
        self, name: str, df: DataFrame, key: str, fields: dict[str, tuple], privacy: Column | str = "public", provenance: dict[str, Column | str] | None = None
    ) -> Entity:
        """fields: name -> (kind, value column[, present condition[, options]]). Nulls of value are explicit. provenance: columns of df
        (or values, as literals) that tell where a row's facts come from, by their names in operators/provenance.py."""
        if isinstance(privacy, str):
            privacy = F.lit(privacy)
        cols, meta = [F.col(key).alias("id"), privacy.alias("privacy")], {}
        for f, (kind, value, *rest) in fields.items():
            value = F.col(value) if isinstance(value, str) else value
            present = rest[0] if rest and rest[0] is not None else F.lit(True)
            cols.append(F.when(present, value).cast(SQL_TYPES[kind]).alias(f"v_{f}"))
            cols.append(present.alias(f"p_{f}"))
            if kind in ("array", "object"):
                cols.append(F.when(present, value).cast("string").alias(f"c_{f}"))
            meta[f] = Field(f, kind, **(rest[1] if len(rest) > 1 else {}))
        table = df.select(*cols)
        self.entities[name] = Entity(name, table, meta, table.schema["id"].dataType.simpleString())
        if provenance:
            from .operators.provenance import add

            there = [F.when(rest[0] if rest and rest[0] is not None else F.lit(True), F.lit(f)) for f, (_, _, *rest) in fields.items()]
            rows = df.select(F.col(key).alias("id"), F.array_compact(F.array(*there)).alias("_fields"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in provenance.items()))
            add(self, name, rows, F.col("_fields"))
        self.note(name, "full")
        self.revision += 1
        return self.entities[name]

    def register_relation(self, type: str, source_type: str, target_type: str, df: DataFrame, logical_key: str | None = None, definition: dict | None = None) -> Relation:
        """df: source, target and, if not all are active and public, active and privacy."""
        cols = {"active": F.lit(True), "privacy": F.lit("public")}
        df = df.select("source", "target", *(F.col(c) if c in df.columns else d.alias(c) for c, d in cols.items()))
        rel = Relation(type, logical_key, source_type, target_type, df, definition)
        self.relations.append(rel)
        self.note(rel.name, "full")
        self.revision += 1
        return rel

    def declaration(self, name: str) -> Relation:
        found = [r for r in self.relations if r.logical_key == name and r.definition]
        if len(found) != 1:
            raise QueryValidationError(f"unknown or ambiguous relation declaration {name}")
        return found[0]

    def edges(self, type: str, source_type: str, target_type: str, logical_key: str | None) -> DataFrame:
        """source, target of the active relations; parallel edges of several keys stay apart."""
        parts = [r for r in self.relations if r.type == type and r.source_type == source_type and r.target_type == target_type and logical_key in (None, r.logical_key)]
        if not parts:
            source, target = self.entity(source_type), self.entity(target_type)
            return self.spark.createDataFrame([], f"source {source.id_type}, target {target.id_type}")
        out = None
        for r in parts:
            df = r.df.filter("active").select("source", "target")
            out = df if out is None else out.unionByName(df)
        return out

    # -- lifecycle of relations and nodes --------------------------------------------------------

    def deactivate_relation(self, logical_key: str, condition: Column) -> None:
        """Sets active to false where condition holds; joins that run again don't bring them back. Without an active edge to
        deactivate nothing changes, and the revision stays."""
        hit, changed = F.coalesce(condition, F.lit(False)), False
        for i, r in enumerate(self.relations):
            if r.logical_key == logical_key and not r.df.filter(F.col("active") & hit).isEmpty():
                self.relations[i], changed = replace(r, df=r.df.withColumn("active", F.col("active") & ~hit)), True
                self.note(r.name, "upsert", r.df.filter(F.col("active") & hit).withColumn("active", F.lit(False)))
        self.revision += changed

    def delete_nodes(self, entity: str, ids: DataFrame) -> None:
        """Removes the nodes (column id) with their attributes, their provenance and their relations; the revision stays if there is none."""
        e = self.entity(entity)
        if e.df.join(ids.select("id"), "id", "left_semi").isEmpty():
            return
        # Rows that surely stay aren't shuffled for the few that go.
        gone = written(ids.select("id").distinct(), "gone")
        likely = Likely(gone, "id")

        def left(rows: DataFrame, by: str) -> DataFrame:
            some, rest = likely.parted(rows, by)
            return some.join(gone.select(F.col("id").alias(by)), by, "left_anti").select(*rows.columns).union(rest)

        if entity in self.provenance:
            self.provenance[entity] = [left(p, "id") for p in self.provenance[entity]]
        self.entities[entity] = replace(e, df=left(e.df, "id"))
        self.note(entity, "delete", gone)
        for i, r in enumerate(self.relations):
            for side, kind in (("source", r.source_type), ("target", r.target_type)):
                if kind == entity:
                    lost = likely.of(r.df, side).join(gone.select(F.col("id").alias(side)), side, "left_semi")
                    self.note(r.name, "delete", lost.select("source", "target").distinct())
                    r = replace(r, df=left(r.df, side))
            self.relations[i] = r
        self.revision += 1

    # -- ontology ----------------------------------------------------------------------------------

    def ontology(self, namespace: str | None = None) -> list[dict]:
        """Entity types with their fields, and relations, in the literal namespace prefix."""

        def inside(entity: str) -> bool:
            ns = entity.rpartition(".")[0]
            return namespace is None or ns == namespace or ns.startswith(f"{namespace}.")

        shape = [{"type": e.name, "fields": [{"name": f.name, "type": f.json_type, "privacy": f.privacy, "searchable": f.searchable} for f in e.fields.values()]} for e in self.entities.values() if inside(e.name)]
        joins = [{"relation": r.type, "logical_key": r.logical_key, "from": r.source_type, "to": r.target_type} for r in self.relations if inside(r.source_type)]
        return sorted(shape, key=lambda x: x["type"]) + sorted(joins, key=canonical_json)

    def ontology_fingerprint(self) -> str:
        """Of the shape alone: no statistics, no provenance."""
        return sha256_json(self.ontology())

    def ontology_statistics(self, namespace: str | None = None) -> DataFrame:
        """entity_type, field, json_type, n_nodes, n_present, n_null: one aggregation per entity type."""
        out = None
        for e in self.entities.values():
            ns = e.name.rpartition(".")[0]
            if namespace is not None and ns != namespace and not ns.startswith(f"{namespace}."):
                continue
            aggs = [F.count("*").alias("n")]
            for f in e.fields:
                aggs += [F.count_if(F.col(f"p_{f}")).alias(f"p_{f}"), F.count_if(F.col(f"p_{f}") & F.col(f"v_{f}").isNull()).alias(f"z_{f}")]
            one = e.df.agg(*aggs)
            rows = F.explode(F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(f.json_type).alias("json_type"), F.col(f"p_{f.name}").alias("n_present"), F.col(f"z_{f.name}").alias("n_null")) for f in e.fields.values())))
            one = one.select(F.lit(e.name).alias("entity_type"), F.col("n").alias("n_nodes"), rows.alias("s")).select("entity_type", "s.field", "s.json_type", "n_nodes", "s.n_present", "s.n_null")
            out = one if out is None else out.unionByName(one)
        return out

    def relation_statistics(self) -> DataFrame:
        out = None
        for r in self.relations:
            one = r.df.agg(F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_inactive")).select(F.lit(r.type).alias("relation"), F.lit(r.logical_key).alias("logical_key"), "n_active", "n_inactive")
            out = one if out is None else out.unionByName(one)
        return out

    # -- privacy -------------------------------------------------------------------------------------

    def sanitized(self) -> Memory:
        """Public nodes, their public attributes, and public relations with both ends public."""
        out = Memory(self.spark, f"{self.name}-public", self.generation, self.revision)
        for e in self.entities.values():
            open_ = {n: f for n, f in e.fields.items() if f.privacy == "public"}
            cols = [c for c in e.df.columns if c in ("id", "privacy") or c[2:] in open_]
            out.entities[e.name] = Entity(e.name, e.df.filter("privacy = 'public'").select(*cols), open_, e.id_type)
        for r in self.relations:
            df = r.df.filter("privacy = 'public'")
            for side, kind in (("source", r.source_type), ("target", r.target_type)):
                df = df.join(out.entity(kind).df.select(F.col("id").alias(side)), side, "left_semi")
            out.relations.append(replace(r, df=df.select("source", "target", "active", "privacy")))
        return out

    def reclassify(self, entity: str, privacy: Column) -> None:
        """Sets nodes' privacy; a relation is as private as the stricter of its ends."""
        e = self.entity(entity)
        if e.df.filter(~F.col("privacy").eqNullSafe(privacy)).isEmpty():
            return
        self.note(entity, "upsert", e.df.filter(~F.col("privacy").eqNullSafe(privacy)).withColumn("privacy", privacy))
        self.entities[entity] = replace(e, df=e.df.withColumn("privacy", privacy))
        for i, r in enumerate(self.relations):
            if entity in (r.source_type, r.target_type):
                self.relations[i] = replace(r, df=self.with_end_privacy(r.df, r.source_type, r.target_type))
                self.note(r.name, "full")
        self.revision += 1

    def with_end_privacy(self, edges: DataFrame, source_type: str, target_type: str) -> DataFrame:
        s = self.entity(source_type).df.select(F.col("id").alias("source"), F.col("privacy").alias("_s"))
        t = self.entity(target_type).df.select(F.col("id").alias("target"), F.col("privacy").alias("_t"))
        strict = F.when((F.col("_s") == "private") | (F.col("_t") == "private"), "private").otherwise("public")
        return edges.drop("privacy").join(s, "source").join(t, "target").withColumn("privacy", strict).select("source", "target", "active", "privacy")

    def join_conflict(self, name: str, definition: dict) -> Relation | None:
        """The earlier relation of that name; another definition under it is an error."""
        for r in self.relations:
            if r.logical_key == name and r.definition:
                if r.definition != definition:
                    raise JoinError(f"join {name} exists with another definition")
                return r
        return None
