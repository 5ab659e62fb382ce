"""Document fingerprints by content-defined chunking.

A 32-byte gear hash runs over the bytes of a text; a boundary is where it meets a mask, a strict
one before the normal chunk size and a loose one after it (normalised chunking), within a least and
a most size. A fingerprint is the set of chunk digests with the chunks' lengths; an edit changes
the chunks it touches and leaves the others, wherever they move. The likeness of two fingerprints
is the length of the chunks that the first shares with the second, as a part of its own length.

Defined cases: null is empty text; empty texts have empty fingerprints, which are alike (1.0) among
themselves and unlike (0.0) any other; repeated chunks count once; texts without a boundary are one
chunk. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Hasher, flat, frugal, slices

LEAST, NORMAL, MOST = 16, 48, 192
_STRICT, _LOOSE = np.uint32(0x7F << 25), np.uint32(0x1F << 27)
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at each byte; texts don't see each other."""
    gap = 31
    n = len(offs) - 1
    shift = np.repeat(np.arange(n, dtype=np.int64) * gap, np.diff(offs))
    h = np.zeros(len(data) + n * gap, np.uint32)
    at = np.arange(len(data)) + shift
    h[at] = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h[at]


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk digests, chunk lengths and chunk offsets per text."""
    h = gear(data, offs)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = loose[(h[loose] & _STRICT) == 0].tolist()
    loose = loose.tolist()
    starts: list[int] = []
    per = [0]
    lo, st = 0, 0
    find = bisect.bisect_left
    for a, z in zip(offs[:-1].tolist(), offs[1:].tolist()):
        while a < z:
            starts.append(a)
            end = z
            if z - a > LEAST:
                st = find(strict, a + LEAST - 1, st)
                if st < len(strict) and strict[st] < a + NORMAL - 1:
                    end = min(strict[st] + 1, z)
                else:
                    lo = find(loose, a + NORMAL - 1, lo)
                    end = min((loose[lo] if lo < len(loose) else z) + 1, a + MOST, z)
            a = end
        per.append(len(starts))
    first = np.array(starts, np.int64)
    ends = np.append(first[1:], len(data)) if len(first) else first
    return Hasher(data, seed=7)(first, ends), ends - first, np.array(per, np.int64)


def fingerprints(texts: pa.Array) -> list[dict[int, int]]:
    """Chunk digest -> chunk length, of each text."""
    digest, size, per = chunks(*flat(texts))
    d, s, p = digest.tolist(), size.tolist(), per.tolist()
    return [dict(zip(d[i:j], s[i:j])) for i, j in zip(p, p[1:])]


def spelled(print_: dict[int, int]) -> str:
    """Digests and lengths in hexadecimal, in the order of the digests."""
    return "".join(["%016x%02x" % x for x in sorted(print_.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / total


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (string) of every text; a map without shuffle."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = T.StructType().add(src.schema["doc_id"]).add("fingerprint", T.StringType())

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([spelled(f) for f in fingerprints(b.column("text"))], pa.string())], names=out.fieldNames())

    return src.mapInArrow(frugal(run), out)


#: Texts' bytes that one range of neighbours is meant to hold.
RANGE_BYTES = 16 << 20


def neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Documents dealt into ranges of doc_id, sorted within, each range closed by a copy (tail) of the
    next one's first document; the last by the very first. Splitters are ids of the table."""
    ids = docs.select("doc_id")
    probs = [k / ranges for k in range(1, ranges)] or [0.5]
    row = ids.agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.percentile_approx("doc_id", probs, 10_000).alias("cuts")).first()
    cuts = sorted({c for c in (row["cuts"] or []) if c > row["first"]})
    heads = [None if row["nulls"] else row["first"], *cuts]

    edges = np.array(cuts)

    @F.pandas_udf("int")
    def own_range(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    is_head = F.col("doc_id").isNull() if heads[0] is None else F.col("doc_id") == F.lit(heads[0])
    if cuts:
        is_head = is_head | F.col("doc_id").isin(cuts)
    own = own_range(F.coalesce("doc_id", F.lit(row["first"]))) if cuts else F.lit(0)
    docs = docs.select("doc_id", "text", own.alias("own"))
    own, before = F.col("own"), F.when(F.col("own") == 0, F.lit(len(cuts))).otherwise(F.col("own") - 1)
    dealt = docs.select("doc_id", "text", F.explode(F.when(is_head, F.array(F.struct(own.alias("at"), F.lit(False).alias("tail")), F.struct(before.alias("at"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(own.alias("at"), F.lit(False).alias("tail"))))).alias("to"))
    dealt = dealt.select(F.col("to.at").alias("at"), F.col("to.tail").alias("tail"), "doc_id", "text")
    return dealt.repartitionById(len(cuts) + 1, F.col("at")).sortWithinPartitions("at", "tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def edited_likeness(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compares each text's fingerprint with that of an edited copy (its second half replaced by the
    head of the next document, ascending doc_id) and of the next document. Equal ids follow each
    other by text; null ids come first."""
    src = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = _ranges(docs)
    out = T.StructType().add(src.schema["doc_id"]).add("n_chars", T.LongType()).add("edited_sha256", T.StringType()).add("fingerprint", T.StringType()).add("edited_fingerprint", T.StringType()).add("near_edited", T.DoubleType()).add("near_next", T.DoubleType())

    def run(batches):
        held = None  # the last document so far, with its fingerprint
        over = False
        for batch in batches:
            for b in slices(batch, "text"):
                if over:
                    break
                texts, tails = b.column("text").to_pylist(), b.column("tail").to_pylist()
                prints, rows = fingerprints(b.column("text")), []
                for doc, text, print_, tail in zip(b.column("doc_id").to_pylist(), texts, prints, tails):
                    if over:
                        break
                    if held:
                        rows.append((*held, text, print_))
                    held, over = (doc, text, print_), tail
                if rows:
                    edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, _, nxt, _ in rows]
                    theirs = fingerprints(pa.array(edited, pa.large_string()))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r[0] for r in rows], b.column("doc_id").type), pa.array([len(r[1]) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([spelled(r[2]) for r in rows], pa.string()), pa.array([spelled(f) for f in theirs], pa.string()),
                        pa.array([likeness(r[2], f) for r, f in zip(rows, theirs)], pa.float64()), pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
                    ], names=out.fieldNames())

    return neighbours(src, ranges).mapInArrow(frugal(run), out)


def _ranges(docs: DataFrame) -> int:
    """Number of ranges from the size of the input as the optimiser knows it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size * 2 // RANGE_BYTES, 8), 20_000))
