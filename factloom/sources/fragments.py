"""Evidence: content-addressed bytes and deterministic fragments of them."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FactloomError
from ..functions.values import canonical_json, json_pointer, normalize_timestamp, strict_loads
from . import files


def _place(root: str, digest: str) -> str:
    return f"{root}/objects/sha256/{digest[:2]}/{digest}"


def put(spark: SparkSession, root: str, data: bytes) -> str:
    """Stores bytes under their digest; an object that is there is checked again."""
    digest = hashlib.sha256(data).hexdigest()
    path = _place(root, digest)
    if not files.write(spark, path, data) and hashlib.sha256(files.read(spark, path)).hexdigest() != digest:
        raise FactloomError(f"object {digest} is damaged")
    return digest


def read(spark: SparkSession, root: str, digest: str, offset: int = 0, limit: int = 1 << 20) -> dict:
    """At most limit bytes of an object from offset, by a positioned read, and whether they reach its end."""
    fs, at = files.system(spark, _place(root, digest))
    size = fs.getFileStatus(at).getLen()
    n = max(0, min(limit, 1 << 20, size - offset))
    stream = fs.open(at)
    try:
        stream.seek(min(offset, size))
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
    finally:
        stream.close()
    return {"data": data, "eof": offset + n >= size}


def audit(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """digest, status (ok, damaged, missing, orphan) of stored objects against known (column digest)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/objects")
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("digest"), F.sha2("content", 256).alias("actual"))
    both = found.join(known.select("digest", F.lit(1).alias("known")), "digest", "full")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("digest"), "damaged").when(F.col("known").isNull(), "orphan").otherwise("ok")
    return both.select("digest", status.alias("status"))


#: The keys of each selector besides `kind`, with the least value of whole numbers, the type of others, and a
#: default where a key may be left out.
SELECTORS: dict[str, dict[str, tuple]] = {
    "whole_object": {},
    "byte_range": {"start": (0,), "end": (0,)},
    "line_range": {"start_line": (1,), "end_line": (1,)},
    "sample_interval": {"start_sample": (0,), "end_sample": (0,), "sample_rate": (1,), "channels": (1,), "bit_width": (1,), "sample_format": (str,), "byte_order": (str,), "interleaved": (bool,)},
    "structured": {"pointer": (str, ""), "input_format": (str, "json")},
    "record_key": {"key_field": (str,), "key_value": (object,), "input_format": (str, "json")},
    "time_interval": {"timestamp_field": (str,), "start": (str,), "end": (str,), "input_format": (str, "json")},
}


def checked(selector: dict | None) -> dict:
    """A selector with its defaults; unknown kinds and keys, missing keys and values of another type raise."""
    given = dict(selector or {"kind": "whole_object"})
    kind = given.pop("kind", None)
    if kind not in SELECTORS:
        raise FactloomError(f"unknown selector {json.dumps(kind)}")
    out = {"kind": kind}
    for key, (want, *default) in SELECTORS[kind].items():
        value = given.pop(key, *default) if default or key in given else _wrong(kind, key)
        whole = isinstance(want, int)
        if (type(value) is not int or value < want) if whole else not isinstance(value, want):
            _wrong(kind, key)
        out[key] = value
    if given:
        raise FactloomError(f"unknown keys of {kind}: {sorted(given)}")
    return out


def _wrong(kind: str, key: str):
    raise FactloomError(f"{kind} needs a proper {key}")


_TEXT, _WHOLE = T.StringType(), T.LongType()
_PARTS = {
    "error": _TEXT, "kind": _TEXT, "first": _WHOLE, "last": _WHOLE, "channels": _WHOLE, "width": _WHOLE, "interleaved": T.BooleanType(), "pointer": _TEXT,
    "field": _TEXT, "key": _TEXT, "begins": _TEXT, "ends": _TEXT, "how": _TEXT,
}
_PLAN = T.StructType([T.StructField(n, t) for n, t in _PARTS.items()])
_RECORD = T.StructType([T.StructField(n, _TEXT) for n in ("text", "key", "at")])
_VIEW = T.StructType([T.StructField("error", _TEXT), T.StructField("found", _TEXT), T.StructField("records", T.ArrayType(_RECORD))])
_FORMATS = ("json", "canonical-json", "jsonl", "canonical-jsonl")
#: Bytes of objects that are parsed before their views leave the worker.
VIEW_BYTES = 1 << 20


@functools.lru_cache(maxsize=4096)
def _planned(selector: str | None) -> tuple:
    """A selector's parts as the plan's columns, with the reason if it is refused."""
    none = (None,) * 12
    try:
        s = checked(json.loads(selector) if selector else None)
        first, last = (next((s[k] for k in keys if k in s), None) for keys in (("start_line", "start_sample", "start"), ("end_line", "end_sample", "end")))
        timed = s["kind"] == "time_interval"
        if "input_format" in s and s["input_format"] not in _FORMATS:
            raise FactloomError(f"unknown input format {s['input_format']}")
        begins, ends = (normalize_timestamp(t) for t in (first, last)) if timed else (None, None)
        if s.get("bit_width", 8) % 8:
            raise FactloomError("samples must be whole bytes")
        if (begins, first)[not timed] is not None and ((begins, ends) if timed else (first, last))[0] > ((begins, ends) if timed else (first, last))[1]:
            raise FactloomError("the range is reversed")
    except (FactloomError, ValueError) as e:
        return (str(e), *none)
    numbers = (None, None) if timed else (first, last)
    key = _key(s["key_value"]) if "key_value" in s else None
    return (None, s["kind"], *numbers, s.get("channels"), s.get("bit_width", 8) // 8, s.get("interleaved"), s.get("pointer"), s.get("key_field") or s.get("timestamp_field"), key, begins, ends, s.get("input_format"))


def _key(value) -> str:
    """A text that two JSON values share if they are equal: 1, 1.0 and true are."""
    if isinstance(value, (bool, int, float)) and value == value // 1:
        return str(int(value))
    return canonical_json(value)


@F.pandas_udf(_PLAN)
def _plan(selectors: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_planned(s) for s in selectors], columns=[*_PARTS], dtype=object)


def _viewed(content: bytes | None, kind: str, how: str, pointer: str | None, field: str | None) -> tuple:
    """What a JSON selector needs of one object: the value at a pointer, or its records with a field's key and instant."""
    if content is None:
        return None, None, None
    try:
        text = bytes(content).decode()
        document = strict_loads(text) if how.endswith("json") else [strict_loads(x) for x in text.splitlines() if x.strip()]
    except ValueError:
        return "the object isn't UTF-8 JSON", None, None
    if kind == "structured":
        try:
            return None, canonical_json(json_pointer(document, pointer)), None
        except KeyError:
            return f"nothing at {pointer}", None, None
    records = []
    for r in document if isinstance(document, list) else [None]:
        if not isinstance(r, dict):
            return "records must be JSON objects", None, None
        try:
            at = normalize_timestamp(r[field]) if kind == "time_interval" else None
        except (KeyError, TypeError, ValueError):
            return "a time interval needs timestamps with offsets", None, None
        records.append((canonical_json(r), _key(r[field]) if field in r else _key(None), at))
    return None, None, records


def _runs(content: pd.Series) -> Iterator[slice]:
    """Runs of objects of about VIEW_BYTES together, or one larger object."""
    ends = content.map(len, na_action="ignore").fillna(0).cumsum().to_numpy()
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(ends.searchsorted(before + VIEW_BYTES, "right")))
        yield slice(first, last)
        first = last


@F.pandas_udf(_VIEW)
def _view(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The views of objects, some at a time: records of a whole batch take many times its bytes."""
    for batch in batches:
        for run in _runs(batch[0]):
            yield pd.DataFrame([_viewed(*r) for r in zip(*(column.iloc[run] for column in batch))], columns=["error", "found", "records"], dtype=object)


def _lines(content: Column) -> Column:
    """Lines of bytes with their ends, as texts of one character a byte."""
    return F.filter(F.split(F.decode(content, "ISO-8859-1"), r"(?<=\n)|(?<=\r)(?!\n)", -1), lambda x: x != "")


def _piece(content: Column, first: Column, length: Column) -> Column:
    return F.substring(content, (first + 1).cast("int"), length.cast("int"))


def fragments(objects: DataFrame) -> DataFrame:
    """digest, fragment (binary), fragment_sha256, error of objects (digest, content, selector as JSON). Byte, line and sample ranges are
    cut by Spark's own functions; JSON is parsed in a helper, and records come back as rows of an array from which Spark picks
    by key or instant. A selector that is refused, or leads nowhere, has an error and no fragment. Ranges may be empty; JSON comes
    back in its canonical form, records as lines. A null selector takes the whole object."""
    p, content = F.col("p"), F.col("content")
    o = objects.select("digest", "content", _plan("selector").alias("p"))
    parsed = p["kind"].isin("structured", "record_key", "time_interval")
    o = o.select("digest", "content", "p", _view(F.when(parsed, content), p["kind"], p["how"], p["pointer"], p["field"]).alias("v"))
    size, n = F.octet_length("content").cast("long"), p["last"] - p["first"]
    frame = p["channels"] * p["width"]
    frames = (size / frame).cast("long")
    planar = F.aggregate(
        F.sequence(F.lit(0).cast("long"), p["channels"] - 1), F.lit(b""),
        lambda done, c: F.concat(done, _piece(content, (c * frames + p["first"]) * p["width"], n * p["width"])),
    )
    lines = _lines(content)
    keyed, timed = p["kind"] == "record_key", p["kind"] == "time_interval"
    picked = F.filter(F.col("v")["records"], lambda r: F.when(keyed, r["key"] == p["key"]).otherwise((r["at"] >= p["begins"]) & (r["at"] < p["ends"])))
    sampled = p["kind"] == "sample_interval"
    outside = F.when(p["kind"] == "line_range", p["last"] > F.size(lines)).when(p["kind"] == "byte_range", p["last"] > size).when(sampled, p["last"] > frames)
    error = (
        F.when(p["error"].isNotNull(), p["error"]).when(F.col("v")["error"].isNotNull(), F.col("v")["error"]).when(sampled & (size % frame != 0), "the object doesn't hold whole frames")
        .when(outside, "the range is outside the object").when(keyed & (F.size(picked) != 1), "a record key selects exactly one record")
    )
    found = (
        F.when(p["kind"] == "whole_object", content).when(p["kind"] == "byte_range", _piece(content, p["first"], n))
        .when(p["kind"] == "line_range", F.encode(F.array_join(F.slice(lines, p["first"].cast("int"), (n + 1).cast("int")), ""), "ISO-8859-1"))
        .when(sampled & p["interleaved"], _piece(content, p["first"] * frame, n * frame)).when(sampled, planar)
        .when(p["kind"] == "structured", F.encode(F.col("v")["found"], "UTF-8"))
        .otherwise(F.encode(F.array_join(F.transform(picked, lambda r: F.concat(r["text"], F.lit("\n"))), ""), "UTF-8"))
    )
    o = o.select("digest", error.alias("error"), "content", "p", "v").select("digest", F.when(F.col("error").isNull(), found).alias("fragment"), "error")
    return o.select("digest", "fragment", F.sha2("fragment", 256).alias("fragment_sha256"), "error")


def extract(spark: SparkSession, data: bytes, selector: dict | None) -> bytes:
    """The fragment of one object."""
    row = fragments(spark.createDataFrame([("", data, json.dumps(selector) if selector else None)], "digest string, content binary, selector string")).first()
    if row["error"]:
        raise FactloomError(row["error"])
    return bytes(row["fragment"])


def reextracted(kept: DataFrame, objects: DataFrame) -> DataFrame:
    """digest, selector, status of kept fragments (digest, selector, fragment_sha256), each cut again from the objects (digest, content) and
    compared: ok, changed, refused (the selector no longer fits) or missing (no object)."""
    both = kept.select("digest", "selector", F.col("fragment_sha256").alias("was")).join(objects.select("digest", "content"), "digest", "left")
    named = both.select(F.struct("digest", "selector", "was", F.col("content").isNotNull().alias("there")).alias("digest"), F.coalesce("content", F.lit(b"")).alias("content"), "selector")
    again, key = fragments(named), F.col("digest")
    status = F.when(~key["there"], "missing").when(F.col("error").isNotNull(), "refused").when(F.col("fragment_sha256") == key["was"], "ok").otherwise("changed")
    return again.select(key["digest"].alias("digest"), key["selector"].alias("selector"), status.alias("status"))


def retention(evidence: DataFrame, as_of: str) -> DataFrame:
    """status, n: retired, active (blocked by a hold or a date) or expired at a time. evidence: digest,
    acquisitions with retention_required, retain_until, retired."""
    at = F.lit(as_of).cast("timestamp")
    blocking = F.col("retention_required") | F.coalesce(F.col("retain_until") > at, F.lit(False))
    per = evidence.groupBy("digest").agg(F.max("retired").alias("retired"), F.count_if(blocking).alias("blocking"))
    status = F.when(F.col("retired"), "retired").when(F.col("blocking") > 0, "active").otherwise("expired")
    return per.select(status.alias("status"), "blocking").groupBy("status").agg(F.count("*").alias("n"), F.sum("blocking").alias("n_blocking"))


#: Bytes of raw sources that one status check reads at most.
STATUS_BYTES = 8 << 20


def source_status(spark: SparkSession, root: str, objects: DataFrame) -> DataFrame:
    """digest, availability, verification of a drill-down's raw sources (digest, size; a page's, so few): the objects that
    fit into STATUS_BYTES, in the order given by digest, are read and checked, the others stay unknown."""
    left, read_, unread = STATUS_BYTES, [], []
    for r in objects.select("digest", "size").distinct().orderBy("digest").collect():
        fits = r["size"] <= left
        left -= r["size"] if fits else 0
        (read_ if fits else unread).append((r["digest"],))
    known = audit(spark, root, spark.createDataFrame(read_, "digest string")).filter(F.col("status") != "orphan")
    known = known.select("digest", F.when(F.col("status") == "missing", "missing").otherwise("available").alias("availability"), F.when(F.col("status") == "ok", "verified").when(F.col("status") == "damaged", "damaged").otherwise("unverified").alias("verification"))
    return known.union(spark.createDataFrame([(d, "unknown", "unverified") for (d,) in unread], "digest string, availability string, verification string"))
