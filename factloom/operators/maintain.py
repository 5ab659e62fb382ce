"""Joins that are kept up to date from what changed: a persisted index of both sides' keys, refreshed by deltas.

With sources S and targets T, a patch adds the edges of dS with T and of S with dT. What a refresh needs of the unchanged rest, it looks up in
four tables beside the memory, each in buckets of what it is looked up by:

    forward_s   source -> its key tuples, the targets they match, and its edges of the relation (with their state)
    inverted_s  key -> source                       forward_t   target -> its key tuples
                                                    inverted_t  key -> target

Sources are affected when they changed, when a changed target has or had one of their keys, or when an edge of theirs was deactivated or
deleted. Only they are matched again; all others keep what they have. A refresh writes a segment with the affected sources and changed
targets, and a row is current when no later segment has its id. After MOST_SEGMENTS the tables are written anew. Only touched buckets are read;
which ones, is one small list of numbers below the fixed count of buckets.

The index's state (segments, totals, how many of the memory's changes it has seen) lies in memory.runs, so a commit holds it with the
tables it belongs to. Where changes can't be told (a table replaced as a whole, or changed and committed without a refresh), the
index is built again by a full run. The result of a refresh equals a full run's: new edges, counters, and the error of an ambiguous target.

Both sides' key fields need one storage type; keys are compared by their text (-0.0 is 0.0). Nulls, missing fields and empty arrays give no
key; sources without one are counted. Equal rows of one id in one note count once; of several notes the last counts.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..memory import Entity, Memory
from ..plans.bloom import Likely
from ..plans.staging import written
from . import relate

MOST_SEGMENTS = 8
#: Looked-up ids or keys that take no filter: a runtime broadcasts about as many.
FEW = 10_000
TOTALS = ("sources", "keyed", "met", "active", "inactive")


def _active() -> Column:
    return F.transform("matched", lambda t: F.struct(t.alias("target"), F.lit(True).alias("active")))


def _inverted(rows: DataFrame) -> DataFrame:
    """id and key (an array of texts, one for each field): a row per key tuple of rows with keys."""
    return rows.select("id", F.explode("keys").alias("key"))


class JoinIndex:
    """The index of one declared join in a folder that all executors share. buckets is fixed when it is built."""

    def __init__(self, memory: Memory, root: str, name: str, relation: str, definition: dict, buckets: int = 64):
        self.memory, self.root, self.name, self.relation, self.definition, self.buckets = memory, root.rstrip("/"), name, relation, definition, buckets
        self.slot = f"join-index:{name}"

    # -- what there is ------------------------------------------------------------------------------------------------
    @property
    def state(self) -> dict | None:
        return self.memory.runs.get(self.slot)

    def _sides(self) -> tuple[Entity, Entity, list, list]:
        source, target = self.memory.entity(self.definition["from"]["type"]), self.memory.entity(self.definition["to"]["type"])
        return source, target, [target.field(f) for f in self.definition["to"]["fields"]], [source.field(f) for f in self.definition["from"]["fields"]]

    def _relation(self):
        return self.memory.join_conflict(self.name, self.definition | {"relation": self.relation})

    def _bucket(self, by: Column) -> Column:
        return F.pmod(F.xxhash64(by), F.lit((self.state or {}).get("buckets", self.buckets))).cast("int")

    def _seen(self) -> dict[str, int] | None:
        """How many of each table's changes the index has seen; None where that can't be told."""
        s, m = self.state, self.memory
        if s is None:
            return None
        if s["commit"] == m.commit and s["generation"] == m.generation:
            return s["seen"]
        return {} if s["revision"] == m.loaded and s["generation"] == m.generation else None

    def _mark(self, segments: list[dict], totals: dict, buckets: int, schemas: dict[str, str]) -> None:
        m = self.memory
        self.memory.runs[self.slot] = {
            "segments": segments, "totals": totals, "buckets": buckets, "schemas": schemas, "generation": m.generation, "commit": m.commit, "revision": m.revision,
            "seen": {n: len(notes) for n, notes in m.changes.items()},
        }

    def _rows(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table's rows of all segments in some buckets, with the number of their segment; overwritten ones are left out."""
        side, out, later = table[-1], None, None
        for at, s in enumerate(self.state["segments"]):
            one = self._read(s["path"], table)
            one = (one if buckets is None else one.filter(F.col("b").isin(buckets))).withColumn("_at", F.lit(at))
            out = one if out is None else out.unionByName(one)
            if at:
                ids = self._read(s["path"], f"forward_{side}").select("id", F.lit(at).alias("_later"))
                later = ids if later is None else later.union(ids)
        if later is not None:
            last = later.groupBy("id").agg(F.max("_later").alias("_later"))
            out = out.alias("r").join(last.alias("l"), (F.col("r.id") == F.col("l.id")) & (F.col("l._later") > F.col("r._at")), "left_anti")
        return out.filter("not gone").drop("_at", "gone") if "gone" in out.columns else out.drop("_at")

    def _read(self, path: str, table: str) -> DataFrame:
        """A segment's part of a table; it may have no row, and then no file. Sources without edges of their own have their matches', active."""
        rows = self.memory.spark.read.schema(self.state["schemas"][table]).parquet(f"{self.root}/{path}/{table}")
        return rows.withColumn("edges", F.coalesce("edges", _active())) if table == "forward_s" else rows

    def _found(self, table: str, wanted: DataFrame, by: str, exact: bool = True) -> DataFrame:
        """The table's current rows whose `by` is in wanted, a table that lies somewhere: a semi-join that reads the wanted rows' buckets alone,
        and shuffles few others. Not exact: there may be some others, and nothing is shuffled for many wanted rows."""
        touched = {r["b"]: r["count"] for r in wanted.groupBy(self._bucket(F.col(by)).alias("b")).count().collect()}
        rows, n = self._rows(table, sorted(touched)), sum(touched.values())
        if n > FEW:
            rows = Likely(wanted, by, rows=n).of(rows, by)
        return rows.join(wanted, by, "left_semi") if exact or n <= FEW else rows

    # -- building -----------------------------------------------------------------------------------------------------
    def _write(self, path: str, tables: dict[str, DataFrame]) -> None:
        """Each task writes its rows into their buckets: they aren't shuffled for that, and a key that a third of them has is written by many tasks."""
        for name, rows in tables.items():
            by = F.col("key" if name.startswith("inverted") else "id")
            rows.withColumn("b", self._bucket(by)).write.partitionBy("b").option("compression", "zstd").parquet(f"{self.root}/{path}/{name}")

    def _part(self) -> Column:
        """Parts of a bucket, so that there are some for every task of a shuffle."""
        n = 4 * int(self.memory.spark.conf.get("spark.sql.shuffle.partitions"))
        return F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-n // self.buckets)))

    def build(self) -> dict:
        """A full run, and the index of what it saw. Returns the run's counters."""
        source, target, targets, sources = self._sides()
        width = len(targets)
        kinds = [dict(relate.key_rows(e, f, p, "x_").dtypes) for e, f, p in ((source, self.definition["from"]["fields"], targets), (target, self.definition["to"]["fields"], sources))]
        if any(kinds[0][f"x_k{i}"] != kinds[1][f"x_k{i}"] for i in range(width)):
            raise QueryValidationError("an index needs key fields of one storage type")
        earlier, path = self._relation(), f"{uuid.uuid4().hex[:12]}-base"
        self.memory.runs.pop(self.slot, None)
        found = relate.met(self.memory, self.definition, True, {"b": self._bucket(F.col("id")), "_part": self._part()}).drop("_part")
        if earlier:
            found = written(found, "join-met")
            counters = relate.keep(self.memory, self.name, self.relation, self.definition, found).first().asDict()
            edges = self._relation().df.groupBy(F.col("source").alias("id")).agg(F.collect_set(F.struct("target", "active")).alias("edges"))
            found = found.join(edges, "id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType))).repartition("b", self._part())
        else:
            found = found.withColumn("edges", F.when(F.lit(False), _active()))  # null: see _read
        found = found.withColumn("gone", F.lit(False))
        found.write.partitionBy("b").option("compression", "zstd").parquet(f"{self.root}/{path}/forward_s")
        found = self.memory.spark.read.schema(found.schema).parquet(f"{self.root}/{path}/forward_s")
        if not earlier:
            counters = relate.keep(self.memory, self.name, self.relation, self.definition, found).first().asDict()
        t_keys = relate.key_lists(target, self.definition["to"]["fields"], sources, F.col("privacy"), F.lit(False).alias("gone"))
        t_keys = t_keys if target.unique else t_keys.distinct()
        tables = {"inverted_s": _inverted(found), "forward_t": t_keys, "inverted_t": _inverted(t_keys) if target.unique else _inverted(t_keys).distinct()}
        self._write(path, tables)
        tables["forward_s"] = found.select("id", "privacy", "gone", "keys", "matched", "edges")
        schemas = {n: ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("b", "int")]) for n, rows in tables.items()}
        self._mark([{"path": path}], {}, self.buckets, schemas)
        self.state["totals"] = self._totals(self._rows("forward_s"))
        return counters

    @staticmethod
    def _told(keys: str = "keys", matched: str = "matched", edges: str = "edges") -> list[Column]:
        """TOTALS of a source, as numbers: with a key, with a match, and its matches by the state of the edge."""
        of = lambda state: F.size(F.filter(edges, lambda e: (e["active"] == state) & F.array_contains(matched, e["target"])))
        return [F.lit(1), (F.size(keys) > 0).cast("int"), (F.size(matched) > 0).cast("int"), of(True), of(False)]

    def _totals(self, rows: DataFrame) -> dict[str, int]:
        """Of current sources: how many, with a key, with a match, and their matches by the state of the edge."""
        return dict(zip(TOTALS, rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in self._told())).first()))

    # -- refreshing ---------------------------------------------------------------------------------------------------
    def _delta(self, e: Entity, fields: list[str], seen: int) -> DataFrame | None:
        """id, gone, privacy and the key columns of the nodes changed since, each as its last note left it; None without a change."""
        need = ["privacy", *(f"{c}_{f}" for f in dict.fromkeys(fields) for c in "vc" if f"{c}_{f}" in e.df.columns)]
        out = None
        for at, (kind, part) in enumerate(self.memory.changes.get(e.name, [])[seen:]):
            had = part.columns if kind == "upsert" else ()
            cols = [(F.col(c) if c in had else F.lit(None).cast(e.df.schema[c].dataType)).alias(c) for c in need]
            one = part.select("id", *cols, F.lit(kind == "delete").alias("gone"), F.lit(at).alias("_at"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return None
        last = out.groupBy("id").agg(F.max_by(F.struct(*need, "gone"), "_at").alias("r")).select("id", "r.*")
        return written(last, "join-delta")

    def _none(self, e: Entity, fields: list[str]) -> DataFrame:
        need = ["privacy", *(f"{c}_{f}" for f in dict.fromkeys(fields) for c in "vc" if f"{c}_{f}" in e.df.columns)]
        return self.memory.spark.createDataFrame([], e.df.select("id", *need).schema).withColumn("gone", F.lit(False))

    def refresh(self) -> dict:
        """Brings relation and index up to date with the memory's changes; returns the counters that a full run would give, and the
        number of sources that were matched again, or rebuilt: True where a full run was needed."""
        seen, rel = self._seen(), self._relation()
        source, target, s_pair, t_pair = self._sides()
        names = (source.name, target.name, rel.name if rel else "")
        if seen is None or rel is None or any(kind == "full" for n in names for kind, _ in self.memory.changes.get(n, [])[seen.get(n, 0) :]):
            return self.build() | {"rebuilt": True}
        sf, tf = self.definition["from"]["fields"], self.definition["to"]["fields"]
        ds, dt = self._delta(source, sf, seen.get(source.name, 0)), self._delta(target, tf, seen.get(target.name, 0))
        touched = self._edges(rel, seen.get(rel.name, 0))
        if ds is None and dt is None and touched is None:
            return self._counters(self.state["totals"], 0) | {"rebuilt": False, "rematched": 0}
        ds, dt = ds if ds is not None else self._none(source, sf), dt if dt is not None else self._none(target, tf)
        s_new = relate.key_lists(replace(source, df=ds), sf, s_pair, F.col("privacy"), F.col("gone"))
        t_new = relate.key_lists(replace(target, df=dt), tf, t_pair, F.col("privacy"), F.col("gone"))
        there = F.when(~F.col("gone"), F.col("keys")).otherwise(F.array().cast("array<array<string>>"))
        s_new, t_new = s_new.withColumn("keys", there), t_new.withColumn("keys", there)
        # Keys that a changed target has or had; the sources with one of them.
        t_old = _inverted(self._found("forward_t", dt.select("id"), "id"))
        hit = self._found("inverted_s", written(t_old.union(_inverted(t_new)).select("key").distinct(), "join-wanted"), "key").select("id")
        affected = ds.select("id").union(hit)
        if touched is not None:
            affected = affected.union(touched.select(F.col("source").alias("id")))
        affected = written(affected.distinct(), "join-affected")
        now = written(self._now(affected, s_new, touched), "join-now")
        rows = self._matched(now, dt, t_new, target.id_type)
        made = F.filter("matched", lambda t: ~F.exists("edges", lambda e: e["target"] == t))
        after = rows.withColumn("made", made).withColumn("edges", F.concat("edges", F.transform("made", lambda t: F.struct(t.alias("target"), F.lit(True).alias("active")))))
        path = f"{uuid.uuid4().hex[:12]}-delta"
        self._write(path, {"forward_s": after})
        wrote = self.memory.spark.read.schema(after.schema).parquet(f"{self.root}/{path}/forward_s")
        self._write(path, {"inverted_s": _inverted(wrote), "forward_t": t_new, "inverted_t": _inverted(t_new)})
        here = [F.when(~F.col("gone"), c) for c in self._told()]
        less = [F.coalesce(F.col("was")[n], F.lit(0)) for n in TOTALS]
        got = wrote.agg(*(F.coalesce(F.sum(F.coalesce(h, F.lit(0)) - x), F.lit(0)).alias(n) for n, h, x in zip(TOTALS, here, less)), F.coalesce(F.sum(F.size("made")), F.lit(0)).alias("made"), F.count_if(~F.col("gone")).alias("left")).first()
        totals, n_made = {n: self.state["totals"][n] + got[n] for n in TOTALS}, got["made"]
        if n_made:
            fresh = self._private(wrote.select(F.col("id").alias("source"), F.col("privacy").alias("_s"), F.explode("made").alias("target")), dt)
            self.memory.note(rel.name, "upsert", fresh)
            self.memory.relations[self.memory.relations.index(rel)] = replace(rel, df=rel.df.unionByName(fresh))
            self.memory.revision += 1
        self._mark([*self.state["segments"], {"path": path}], totals, self.state["buckets"], self.state["schemas"])
        if len(self.state["segments"]) > MOST_SEGMENTS:
            self.compact()
        return self._counters(totals, n_made) | {"rebuilt": False, "rematched": got["left"]}

    def _now(self, affected: DataFrame, changed: DataFrame, touched: DataFrame | None) -> DataFrame:
        """A row per affected source: id, privacy, gone, keys, the edges it has (with their state), and was, what it counted for before. All
        that is known of a source is joined by its id at once."""
        old = self._found("forward_s", affected, "id", exact=False).select("id", F.col("privacy").alias("_p"), F.col("keys").alias("_k"), F.col("edges").alias("_e"), F.struct(*(c.alias(n) for n, c in zip(TOTALS, self._told()))).alias("was"))
        rows = affected.join(old, "id", "left").join(changed, "id", "left").filter(F.col("was").isNotNull() | F.col("gone").isNotNull())
        none = F.array().cast(old.schema["_e"].dataType)
        edges = F.coalesce("_e", none)
        if touched is not None:
            per = touched.groupBy(F.col("source").alias("id")).agg(F.collect_list(F.struct("target", "active", "gone")).alias("_t"))
            rows = rows.join(per, "id", "left").withColumn("_t", F.coalesce("_t", F.array().cast(per.schema["_t"].dataType)))
            said = F.transform(F.filter("_t", lambda t: ~t["gone"]), lambda t: F.struct(t["target"].alias("target"), t["active"].alias("active")))
            edges = F.concat(F.filter(edges, lambda e: ~F.exists("_t", lambda t: t["target"] == e["target"])), said)
        new = F.col("gone").isNotNull()
        gone = F.coalesce("gone", F.lit(False))
        return rows.select(
            "id", F.when(new, F.col("privacy")).otherwise(F.col("_p")).alias("privacy"), gone.alias("gone"), F.when(new, F.col("keys")).otherwise(F.col("_k")).alias("keys"),
            F.when(gone, none).otherwise(edges).alias("edges"), "was",
        )

    def _matched(self, now: DataFrame, dt: DataFrame, t_new: DataFrame, id_type: str) -> DataFrame:
        """now with matched, the targets of the keys. Where no source has more than one key, its row goes to the key and stays there."""
        index = self._found("inverted_t", _inverted(now).select("key"), "key", exact=False).select("id", "key").join(dt.select("id"), "id", "left_anti").union(_inverted(t_new))
        index = index.groupBy("key").agg(F.min("id").alias("t"), (F.min("id") != F.max("id")).alias("many"))
        one = F.when(F.col("many"), F.raise_error(F.lit("ambiguous_target: multiple targets for a key")).cast(id_type)).otherwise(F.col("t"))
        none = F.array().cast(f"array<{id_type}>")
        if not now.filter(F.size("keys") > 1).isEmpty():
            per = _inverted(now).join(index, "key").groupBy("id").agg(F.collect_set(one).alias("matched"))
            return now.join(per, "id", "left").withColumn("matched", F.coalesce("matched", none))
        rows = now.filter(F.size("keys") > 0).withColumn("key", F.col("keys")[0]).join(index, "key", "left")
        rows = rows.select(*now.columns, F.when(F.col("t").isNotNull(), F.array(one)).otherwise(none).alias("matched"))
        return rows.union(now.filter(F.size("keys") == 0).withColumn("matched", none))  # sources without a key would share a partition

    def _private(self, made: DataFrame, targets: DataFrame) -> DataFrame:
        """New edges (source, target, _s: the source's privacy) as private as the stricter of their ends, which the index knows too."""
        wanted = written(made.select(F.col("target").alias("id")).distinct(), "join-wanted")
        old = self._found("forward_t", wanted, "id", exact=False).select("id", "privacy").join(targets.select("id"), "id", "left_anti")
        t = old.union(targets.filter("not gone").select("id", "privacy")).select(F.col("id").alias("target"), F.col("privacy").alias("_t"))
        strict = F.when((F.col("_s") == "private") | (F.col("_t") == "private"), "private").otherwise("public")
        return written(made.join(t, "target").select("source", "target", F.lit(True).alias("active"), strict.alias("privacy")), "join-fresh")

    def _edges(self, rel, seen: int) -> DataFrame | None:
        """source, target, active, gone of the edges that others changed since."""
        out = None
        for at, (kind, part) in enumerate(self.memory.changes.get(rel.name, [])[seen:]):
            one = part.select("source", "target", (F.col("active") if kind == "upsert" else F.lit(False)).alias("active"), F.lit(kind == "delete").alias("gone"), F.lit(at).alias("_at"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return None
        return written(out.groupBy("source", "target").agg(F.max_by(F.struct("active", "gone"), "_at").alias("r")).select("source", "target", "r.*"), "join-edges")

    @staticmethod
    def _counters(totals: dict, created: int) -> dict:
        return {
            "created": created, "previously_active": totals["active"] - created, "previously_inactive": totals["inactive"],
            "skipped_null_or_missing": totals["sources"] - totals["keyed"], "skipped_unmatched": totals["keyed"] - totals["met"],
        }

    def compact(self) -> None:
        """All segments as one. The old ones stay, as earlier commits may name them."""
        path, s = f"{uuid.uuid4().hex[:12]}-base", self.state
        tables = {}
        for name in ("forward_s", "inverted_s", "forward_t", "inverted_t"):
            rows = self._rows(name).drop("b")
            tables[name] = rows.withColumn("gone", F.lit(False)) if name.startswith("forward") else rows
        self._write(path, tables)
        s["segments"] = [{"path": path}]
