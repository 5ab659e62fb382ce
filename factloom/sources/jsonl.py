"""JSONL as entities: strict reading, type inference, validation, keyed upsert and declarations."""

from __future__ import annotations

import hashlib
from dataclasses import replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImportRejected, QueryValidationError
from ..functions.values import canonical_json, json_type, stable_uuid, strict_loads
from ..memory import Entity, Field, Memory
from ..operators import provenance
from ..plans.bloom import Likely
from ..plans.staging import written

MAX_LINE_BYTES = 4 << 20
#: Field names that are refused, in whatever letter case.
CREDENTIALS = ("api_key", "apikey", "authorization", "password", "passwd", "secret", "token")
MAX_FILE_BYTES = 64 << 20
#: Lines that a task parses and keeps for the passes over them.
TASK_LINES = 100_000
_ATTRIBUTE = pa.struct([("field", pa.string()), ("kind", pa.string()), ("canon", pa.string()), ("text", pa.string()), ("num", pa.float64()), ("whole", pa.string())])
_PARSED = "line long, error string, attrs array<struct<field:string,kind:string,canon:string,text:string,num:double,whole:string>>"


def read_lines(df: DataFrame) -> DataFrame:
    """line (number), value: the non-blank lines of a text DataFrame (column value; with or without line)."""
    if "line" not in df.columns:
        df = df.withColumn("line", F.monotonically_increasing_id())
    return df.select("line", "value").filter(F.col("value").rlike(r"\S"))


def read_file(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Lines of one JSONL file by number, from 1, and the SHA-256 of its bytes. A byte order mark, other
    bytes than UTF-8 and files above MAX_FILE_BYTES are refused."""
    file = spark.read.format("binaryFile").load(path)
    about = file.select("length", F.sha2("content", 256).alias("digest"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.hex(F.substring("content", 1, 3)).alias("head")).collect()
    if len(about) != 1 or about[0]["length"] > MAX_FILE_BYTES:
        raise ImportRejected(f"{path} must be one file of at most {MAX_FILE_BYTES} bytes")
    if not about[0]["valid"] or about[0]["head"] == "EFBBBF":
        raise ImportRejected("the file isn't UTF-8 without a byte order mark")
    lines = file.select(F.posexplode(F.split(F.col("content").cast("string"), "\r?\n", -1)).alias("at", "value"))
    return lines.select((F.col("at") + 1).cast("long").alias("line"), "value"), about[0]["digest"]


def import_file(memory: Memory, entity_type: str, path: str, key: dict[str, str], privacy: str = "public") -> dict:
    """import_jsonl of a file; its digest is its content hash."""
    lines, digest = read_file(memory.spark, path)
    return import_jsonl(memory, entity_type, lines, key, privacy, digest)


def parsed(lines: DataFrame, only: list[str] | None = None) -> DataFrame:
    """line, error, attrs (field, kind, canon, text, num, whole of each member, or of those named): one row per line."""

    def run(batches):
        for b in batches:
            line = b.column("line").to_pylist()
            got = [_attributes(v, only) for v in b.column("value").to_pylist()]
            errors = [g if isinstance(g, str) else None for g in got]
            rows = [[] if isinstance(g, str) else g for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(errors, pa.string()), pa.array(rows, pa.list_(_ATTRIBUTE))], names=["line", "error", "attrs"])

    return lines.select("line", "value").mapInArrow(run, _PARSED)


def attributes(lines: DataFrame) -> DataFrame:
    """One row per attribute of each line: line, field, kind, canon, text, num, whole, error."""
    return _exploded(parsed(lines))


def _exploded(rows: DataFrame) -> DataFrame:
    each = rows.select("line", "error", F.explode_outer("attrs").alias("a")).filter(F.col("a").isNotNull() | F.col("error").isNotNull())
    return each.select("line", "a.field", "a.kind", "a.canon", "a.text", "a.num", "a.whole", "error")


def _attributes(value: str, only: list[str] | None = None) -> list[tuple] | str:
    """Members of one line's object, or why it is refused, whatever members are asked for."""
    if 4 * len(value) > MAX_LINE_BYTES and len(value.encode()) > MAX_LINE_BYTES:
        return "line too long"
    if value.startswith("\ufeff"):
        return "byte order mark"
    try:
        doc = strict_loads(value)
    except ValueError as e:
        return f"invalid JSON: {e}"
    if not isinstance(doc, dict):
        return "not an object"
    out = []
    for name, v in doc.items():
        if name.lower() in CREDENTIALS:
            return f"field {name} is a credential's name"
        kind, num, whole = json_type(v), None, None
        if kind == "number":
            try:
                num = float(v)
            except OverflowError:
                return f"field {name} is a number out of range"
            whole = str(int(v)) if num.is_integer() else None
        if only is not None and name not in only:
            continue
        out.append((name, kind, None if v is None else canonical_json(v), v if kind == "string" else None, num, whole))
    return out


def infer(attrs: DataFrame) -> DataFrame:
    """field, json_type (null if only nulls were seen), n_types, n_present, n_null: the schema of a file.
    A field with more than one type is an error for the caller to raise."""
    kind = F.when(F.col("kind") != "null", F.col("kind"))
    return attrs.filter("error is null").groupBy("field").agg(F.min(kind).alias("json_type"), F.countDistinct(kind).alias("n_types"), F.count("*").alias("n_present"), F.count_if(F.col("kind") == "null").alias("n_null"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Key tuples that more than one of the parsed lines has. A line's members come in one row, so only key tuples are shuffled."""
    of = F.map_from_arrays(F.transform("attrs", lambda a: a["field"]), F.transform("attrs", lambda a: a["canon"]))
    keyed = rows.filter(F.exists("attrs", lambda a: a["field"].isin(key))).select(of.alias("_of"))
    return keyed.select(*(F.try_element_at("_of", F.lit(k)).alias(k) for k in key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def check(rows: DataFrame, key: dict[str, str], entity: Entity | None, total: int) -> list[dict]:
    """Raises ImportRejected with the first offence of parsed lines; returns the inferred fields. One aggregation by
    field; lines that are refused as such stand under no field."""
    off = F.lit(False)
    for k, kind in key.items():
        wrong = F.col("kind") != {"integer": "number"}.get(kind, kind)
        off |= (F.col("field") == k) & (wrong | F.col("canon").rlike(r"[.eE]") if kind == "integer" else wrong)
    kinds = F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))
    found = _exploded(rows).groupBy("field").agg(
        F.sort_array(kinds).alias("kinds"), F.count("*").alias("n_present"), F.count_if(F.col("kind") == "null").alias("n_null"),
        F.count_if(off).alias("n_off"), F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error"))).alias("first"),
    ).collect()
    for r in found:
        if r["first"]:
            raise ImportRejected(f"line {r['first']['line']}: {r['first']['error']}")
    fields = [{"field": r["field"], "json_type": r["kinds"][0] if r["kinds"] else None, "n_types": len(r["kinds"]), "n_present": r["n_present"], "n_null": r["n_null"], "n_off": r["n_off"]} for r in found]
    for f in fields:
        known = entity.fields.get(f["field"]) if entity else None
        if f["n_types"] > 1 or known and known.kind != "unresolved" and f["json_type"] and known.json_type != f["json_type"]:
            raise ImportRejected(f"field {f['field']} mixes types")
        if known and not known.nullable and f["n_null"]:
            raise ImportRejected(f"field {f['field']} is not nullable")
    by_name = {f["field"]: f for f in fields}
    for k, kind in key.items():
        if total and (k not in by_name or by_name[k]["n_present"] != total or by_name[k]["n_off"]):
            raise ImportRejected(f"key {k} must be a non-null {kind} in every line")
    return fields


def _wide(rows: DataFrame, fields: list[Field], *more: Column) -> DataFrame:
    """line, more and the entity columns of each field, from parsed lines: no shuffle."""
    rows = rows.select("line", *more, F.map_from_arrays(F.transform("attrs", lambda a: a["field"]), F.col("attrs")).alias("_of"))
    cols: list[Column] = []
    for f in fields:
        a = F.try_element_at("_of", F.lit(f.name))
        if f.kind == "boolean":
            v = a["canon"] == "true"
        else:
            v = a[{"string": "text", "number": "num"}.get(f.kind, "canon")]
        cols += [v.alias(f"v_{f.name}"), a.isNotNull().alias(f"p_{f.name}")]
        if f.kind in ("number", "array", "object"):
            cols.append(a["canon"].alias(f"c_{f.name}"))
        if f.kind == "number":  # null above 38 digits: such a number only has its double
            cols.append(a["whole"].try_cast("decimal(38,0)").alias(f"i_{f.name}"))
    return rows.select(*(c for c in rows.columns if c != "_of"), *cols)


def _columns(f: Field) -> list[str]:
    return [f"v_{f.name}", f"p_{f.name}", *([f"c_{f.name}"] if f.kind in ("number", "array", "object") else []), *([f"i_{f.name}"] if f.kind == "number" else [])]


def _empty(f: Field) -> list[Column]:
    kinds = {"v": {"number": "double", "boolean": "boolean"}.get(f.kind, "string"), "c": "string", "i": "decimal(38,0)"}
    return [F.lit(False).alias(c) if c[0] == "p" else F.lit(None).cast(kinds[c[0]]).alias(c) for c in _columns(f)]


def node_name(entity_type: str, *keys: str) -> Column:
    """The id of a node by its key: a hash of the key as JSON, in which no two tuples of texts look alike."""
    h = F.sha2(F.to_json(F.array(F.lit(entity_type), *(F.col(k) for k in keys))), 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def import_jsonl(
    memory: Memory, entity_type: str, lines: DataFrame, key: dict[str, str], privacy: str = "public", content_hash: str | None = None, source: dict | None = None, at: datetime | None = None
) -> dict:
    """Keyed upsert: a line patches the node with its key (absent fields keep their value, explicit nulls
    overwrite) or creates one. Fails as a whole. The same content, type and key replay the stored result.
    source: kind, locator and fragment_id of where the lines come from, for their provenance; at: when."""
    lines, total = read_lines(lines), None
    if content_hash is None:
        row = lines.agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h"), F.sum(F.crc32(F.col("value").cast("binary"))).alias("c")).first()
        total = row["n"]
        content_hash = hashlib.sha256(canonical_json([str(x) for x in row]).encode()).hexdigest()
    idempotency = hashlib.sha256(canonical_json([content_hash, entity_type, key]).encode()).hexdigest()
    done = memory.imports
    if idempotency in done:
        return done[idempotency] | {"replayed": True}
    total = lines.count() if total is None else total
    # On disk alone: in memory, they filled the executors' heap before Spark counted its share as full.
    rows = parsed(dealt(lines, total)).persist(StorageLevel.DISK_ONLY)
    try:
        result, seen = _import(memory, entity_type, rows, key, privacy, total)
    finally:
        rows.unpersist()
    said = {"kind": "jsonl", "locator": f"sha256:{content_hash}", "fragment_id": None} | (source or {})
    source_id = stable_uuid("source", said["kind"], said["locator"])
    provenance.register(memory, "sources", memory.spark.createDataFrame([(source_id, said["kind"], said["locator"])], provenance.CATALOG["sources"]))
    written_by = {"source_id": source_id, "batch_id": stable_uuid("batch", idempotency), "fragment_id": said["fragment_id"], "updated_at": at or datetime.now(UTC)}
    provenance.add(memory, entity_type, seen, F.col("_fields"), **written_by)
    done[idempotency] = result
    return result


def dealt(lines: DataFrame, total: int) -> DataFrame:
    """The lines, about TASK_LINES to a partition: a small file of many lines is one split."""
    n = -(-total // TASK_LINES)
    return lines.repartition(n, "line") if n > 1 else lines


def _import(memory: Memory, entity_type: str, rows: DataFrame, key: dict[str, str], privacy: str, total: int) -> tuple[dict, DataFrame]:
    """The result, and id, record, _fields of the lines. The new table is written once: counters, duplicates and the provenance are
    read from it, and the next import's plan starts at it."""
    old = memory.entities.get(entity_type)
    inferred = check(rows, key, old, total)
    fields = dict(old.fields) if old else {}
    delta = {"new_entity": old is None, "new_fields": [], "resolved_types": []}
    for f in sorted(inferred, key=lambda f: f["field"]):
        kind = {None: "unresolved"}.get(f["json_type"], f["json_type"])
        known = fields.get(f["field"])
        if known is None:
            fields[f["field"]] = Field(f["field"], kind)
            delta["new_fields"].append(f["field"])
        elif known.kind == "unresolved" and kind != "unresolved":
            fields[f["field"]] = replace(known, kind=kind)
            delta["resolved_types"].append(f["field"])
    seen = {f["field"] for f in inferred}
    said = F.transform("attrs", lambda a: a["field"]).alias("_fields")
    new = _wide(rows, [fields[n] for n in seen], said)
    keys = [f"c_{k}" if fields[k].kind == "number" else f"v_{k}" for k in key]
    if old is None:
        missing = [c for n, f in fields.items() if n not in seen for c in _empty(f)]
        had = [c for f in fields.values() for c in _columns(f) if c in new.columns]
        table = new.select(node_name(entity_type, *keys).alias("id"), F.lit(privacy).alias("privacy"), *had, *missing, F.lit("created").alias("_kind"), F.lit(True).alias("_new"), "line", "_fields")
    else:
        current = old.df
        for n, f in fields.items():
            before = old.fields.get(n)
            if before is None:
                current = current.select("*", *_empty(f))
            elif before.kind != f.kind:
                current = _retype(current, before, f)
        table = _patched(current, new, entity_type, fields, seen, keys, privacy, total)
    table = written(table, "entity")
    told = F.col("line").isNotNull()
    required = F.lit(False)
    for f in fields.values():
        required |= F.lit(f.required) & ~F.col(f"p_{f.name}")
    made = F.col("_kind") == "created"
    # By a hash of the id, a fourth as long: the sums are the same, and a hash that several lines have is looked at again.
    per = table.filter(told).groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n"), F.count_if(made).alias("created"), F.count_if("_new").alias("changed"), F.count_if(made & required).alias("short"))
    got = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "created", "changed", "short")), F.max("n").alias("most")).first()
    if got["n"] > total:
        raise ImportRejected("ambiguous import key")
    if (got["most"] or 0) > 1 and not table.filter(told).groupBy("id").count().filter("count > 1").isEmpty():
        raise ImportRejected("duplicate keys in the file")
    if got["short"]:
        raise ImportRejected(f"a required field of {entity_type} is missing in a new node")
    if got["changed"] or old is None or fields != old.fields:  # else no fact has changed
        rows = table.drop("_kind", "_new", "line", "_fields")
        kinds = {n: f.kind for n, f in old.fields.items()} if old else None
        if kinds is None or any(fields[n].kind != k for n, k in kinds.items()):
            memory.note(entity_type, "full")
        else:
            memory.note(entity_type, "upsert", table.filter("_new").select(*rows.columns))
        # A new node's id could be one whose key another import has changed since.
        unique = old is None or (old.unique and not got["created"])
        memory.entities[entity_type] = Entity(entity_type, rows, fields, "string", unique)
        memory.revision += 1
    result = {"created": got["created"], "updated": got["n"] - got["created"], "ontology_delta": delta, "replayed": False}
    return result, table.filter(told).select("id", F.col("line").alias("record"), "_fields")


def _patched(current: DataFrame, new: DataFrame, entity_type: str, fields: dict[str, Field], seen: set[str], keys: list[str], privacy: str, total: int) -> DataFrame:
    """All nodes after the lines' patches, and of the nodes that a line made or patched also _kind, line, _fields, and whether anything is
    _new. A line that matches several nodes stands in a row for each; one that shares its key shares its id. Nodes whose key surely is in no
    line aren't shuffled."""
    current, rest = Likely(new, *keys, rows=total).parted(current, *keys)
    a, b = current.alias("a"), new.alias("b")
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    cols, changed = [], F.col("a.id").isNull()
    for n, f in fields.items():
        patched = F.coalesce(F.col(f"b.p_{n}"), F.lit(False)) if n in seen else F.lit(False)
        for c in _columns(f):
            was = F.col(f"a.{c}")
            if c[0] == "p":
                value = patched | F.coalesce(was, F.lit(False))
            else:
                value = F.when(patched, F.col(f"b.{c}")).otherwise(was) if n in seen else was
            cols.append(value.alias(c))
            if n in seen:
                changed |= ~value.eqNullSafe(F.coalesce(was, F.lit(False)) if c[0] == "p" else was)
    kind = F.when(F.col("a.id").isNull(), "created").when(F.col("b.line").isNotNull(), "updated").alias("_kind")
    named = [F.col(f"b.{c}").alias(f"_k{i}") for i, c in enumerate(keys)]
    rows = a.join(b, same, "full").select(F.col("a.id").alias("_id"), F.coalesce("a.privacy", F.lit(privacy)).alias("privacy"), *cols, kind, changed.alias("_new"), *named, "b.line", "b._fields")
    made = node_name(entity_type, *(f"_k{i}" for i in range(len(keys))))
    rows = rows.select(F.coalesce("_id", made).alias("id"), *(c for c in rows.columns if c != "_id" and c not in [f"_k{i}" for i in range(len(keys))]))
    here = {"privacy": F.coalesce("privacy", F.lit(privacy)), "_new": F.lit(False)}
    return rows.union(rest.select(*(here.get(c, F.col(c)) if c in rest.columns or c in here else F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns)))


def _retype(current: DataFrame, before: Field, after: Field) -> DataFrame:
    """A field that only held nulls gets the columns of its learned type."""
    cols = [c for c in current.columns if c not in _columns(before)]
    fill = [F.col(c) if c[0] == "p" else e for c, e in zip(_columns(after), _empty(after))]
    return current.select(*cols, *fill)


def declare(memory: Memory, entity_type: str, fields: dict[str, dict]) -> None:
    """Replaces an entity type's declaration: kind, privacy, searchable, required, nullable. Fields that it
    leaves out are reset; a type that contradicts the data is an error; nullable=False needs no nulls."""
    old = memory.entities.get(entity_type)
    current = old.fields if old else {}
    out = {}
    for name in {*current, *fields}:
        have, said = current.get(name), dict(fields.get(name, {}))
        kind = said.pop("type", None)
        kind = {"integer": "number"}.get(kind, kind)
        if have and have.kind != "unresolved" and kind and kind != have.json_type:
            raise QueryValidationError(f"{name} is {have.json_type}")
        if have and said.get("nullable") is False and old.df.filter(F.col(f"p_{name}") & F.col(f"v_{name}").isNull()).limit(1).count():
            raise QueryValidationError(f"{name} holds nulls")
        out[name] = Field(name, have.kind if have and have.kind != "unresolved" else kind or "unresolved", **said)
    if old:
        df = old.df
        for n, f in out.items():
            if n not in current:
                memory.note(entity_type, "full")
                df = df.select("*", *_empty(f))
            elif current[n].kind != f.kind:
                memory.note(entity_type, "full")
                df = _retype(df, current[n], f)
        memory.entities[entity_type] = Entity(entity_type, df, out, old.id_type)
    else:
        cols = [c for f in out.values() for c in _empty(f)]
        df = memory.spark.range(0).select(F.lit("").alias("id"), F.lit("public").alias("privacy"), *cols)
        memory.entities[entity_type] = Entity(entity_type, df, out)
    memory.revision += 1
