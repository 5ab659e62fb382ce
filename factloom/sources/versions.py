"""A memory as a chain of commits: base tables, delta files with tombstones, one small commit file for each revision kept.

A commit writes what has changed since the one it was loaded from: rows that were made or changed, keys that are gone, new parts of the
provenance log; what hasn't changed is named again. Its file, _commits/<number>.json, is written beside and renamed to its number, which
fails where that number exists: of two writers that began at one commit, the second has to load and try again. The results of imports
are part of the commit, so tables and ledger can't disagree, whenever a writer dies.

Reading merges: the base without the keys of later deltas, and of the deltas each key's last row. Deltas are small beside the base, so
the runtime broadcasts their keys while they are below its threshold. When a table has MOST_DELTAS of them, or they have a quarter of its rows, the
next commit writes it as a new base. Older commits stay readable: nothing they name is deleted.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StaleResultError
from ..memory import Entity, Field, Memory, Relation
from . import files

MOST_DELTAS = 8
#: A table is written anew when its deltas have more than this part of its base's rows.
MOST_PART = 0.25


class VersionStore:
    """Commits of one memory under a folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/_commits") if n.endswith(".json") and n[:-5].isdigit())

    # -- reading ------------------------------------------------------------------------------------------------------
    def load(self, number: int | None = None, name: str = "default") -> Memory:
        """The memory at a commit, or the last; an empty one where there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return Memory(self.spark, name, generation=str(uuid.uuid4()))
        c = files.read_json(self.spark, f"{self.root}/_commits/{number}.json")
        m = Memory(self.spark, c["name"], c["state"]["generation"], c["state"]["data_revision"], imports=c["imports"], runs=c["runs"], namespaces=c["namespaces"], writes=c["writes"])
        for e in c["entities"]:
            fields = {f["name"]: Field(**f) for f in e["fields"]}
            m.entities[e["name"]] = Entity(e["name"], self._table(e["table"], ["id"]), fields, e["id_type"])
        for r in c["relations"]:
            m.relations.append(Relation(r["type"], r["logical_key"], r["source_type"], r["target_type"], self._table(r["table"], ["source", "target"]), r["definition"]))
        for kind, held in (("provenance", m.provenance), ("catalog", m.catalog)):
            for key, paths in c[kind].items():
                parts = [self.spark.read.parquet(f"{self.root}/{p}") for p in paths]
                held[key] = parts if kind == "provenance" else parts[0]
                m.stored += list(zip(parts, paths))
        m.tables = {e["name"]: e["table"] for e in c["entities"]} | {r.name: of["table"] for r, of in zip(m.relations, c["relations"])}
        m.commit, m.loaded, m.changes = number, m.revision, {}
        return m

    def _table(self, table: dict, key: list[str]) -> DataFrame:
        """Base and deltas, merged."""
        base = self.spark.read.parquet(f"{self.root}/{table['base']}")
        if not table["deltas"]:
            return base
        parts = []
        for i, d in enumerate(table["deltas"]):
            rows = self.spark.read.parquet(f"{self.root}/{d['path']}")
            parts.append(rows.withColumn("_seq", F.lit(i)).withColumn("_gone", F.lit(d["kind"] == "delete")))
        every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        last = every.groupBy(*key).agg(F.max_by(F.struct(*(c for c in every.columns if c not in key)), "_seq").alias("_r")).select(*key, "_r.*")
        kept = base.join(last.select(*key), key, "left_anti").unionByName(last.filter("not _gone").drop("_seq", "_gone"), allowMissingColumns=True)
        present = [c for c in kept.columns if c.startswith("p_")]
        return kept.withColumns({c: F.coalesce(c, F.lit(False)) for c in present}) if present else kept

    # -- writing ------------------------------------------------------------------------------------------------------
    def commit(self, memory: Memory) -> int:
        """The number of the new commit; raises if another writer has committed since this memory was loaded."""
        number, stamp = memory.commit + 1, uuid.uuid4().hex[:8]
        if number in self.numbers():
            raise StaleResultError(f"commit {number} exists; load again")
        tables = {}
        for i, (name, df) in enumerate([*((e.name, e.df) for e in memory.entities.values()), *((r.name, r.df) for r in memory.relations)]):
            tables[name] = self._write(memory, name, df, f"{number}-{stamp}/{i}")
        provenance, held = {e: [self._part(memory, p, f"{number}-{stamp}/log-{i}-{k}") for k, p in enumerate(parts)] for i, (e, parts) in enumerate(memory.provenance.items())}, {}
        for n, rows in memory.catalog.items():
            held[n] = [self._part(memory, rows, f"{number}-{stamp}/catalog-{n}")]
        body = {
            "number": number, "name": memory.name, "state": memory.state(), "imports": memory.imports, "runs": memory.runs, "namespaces": memory.namespaces, "writes": memory.writes,
            "entities": [{"name": e.name, "id_type": e.id_type, "fields": [asdict(f) for f in e.fields.values()], "table": tables[e.name]} for e in memory.entities.values()],
            "relations": [{"type": r.type, "logical_key": r.logical_key, "source_type": r.source_type, "target_type": r.target_type, "definition": r.definition, "table": tables[r.name]} for r in memory.relations],
            "provenance": provenance, "catalog": held,
        }
        if not files.write(self.spark, f"{self.root}/_commits/{number}.json", json.dumps(body).encode()):
            raise StaleResultError(f"commit {number} exists; load again")
        memory.commit, memory.loaded, memory.tables, memory.changes = number, memory.revision, tables, {}
        return number

    def _part(self, memory: Memory, rows: DataFrame, path: str) -> str:
        """Where a table that is only replaced or added lies; written if it isn't there."""
        for part, at in memory.stored:
            if part is rows:
                return at
        rows.write.parquet(f"{self.root}/{path}")
        memory.stored.append((rows, path))
        return path

    def _write(self, memory: Memory, name: str, df: DataFrame, path: str) -> dict:
        known, changes = memory.tables.get(name), memory.changes.get(name, [])
        whole = known is None or any(kind == "full" for kind, _ in changes)
        if not whole and not changes:
            return known
        if not whole:
            deltas, rows = list(known["deltas"]), known["rows"]
            for k, (kind, part) in enumerate(changes):
                part.write.parquet(f"{self.root}/{path}-delta-{k}")
                n = self.spark.read.parquet(f"{self.root}/{path}-delta-{k}").count()
                deltas += [{"path": f"{path}-delta-{k}", "kind": kind, "rows": n}] if n else []
            if len(deltas) < MOST_DELTAS and sum(d["rows"] for d in deltas) <= max(MOST_PART * rows, 1):
                return {"base": known["base"], "deltas": deltas, "rows": rows}
        df.write.parquet(f"{self.root}/{path}")
        return {"base": path, "deltas": [], "rows": self.spark.read.parquet(f"{self.root}/{path}").count()}

    def size(self, number: int) -> dict[str, int]:
        """Rows that a commit wrote of each table: deltas and bases that the one before doesn't name."""
        now, before = (files.read_json(self.spark, f"{self.root}/_commits/{n}.json") if n else {"entities": [], "relations": []} for n in (number, number - 1))
        old = {p for t in [*before["entities"], *before["relations"]] for p in (t["table"]["base"], *(d["path"] for d in t["table"]["deltas"]))}
        out = {}
        for t in [*now["entities"], *now["relations"]]:
            parts = [(t["table"]["base"], t["table"]["rows"]), *((d["path"], d["rows"]) for d in t["table"]["deltas"])]
            out[t.get("name") or t["type"]] = sum(n for p, n in parts if p not in old)
        return out

