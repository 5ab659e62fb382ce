"""Exact substring deduplication by a sparse suffix array over content-picked anchors.

Each byte is removed that a `length`-byte string covers which also starts earlier (in a smaller
doc_id, or in the same document before); strings are judged on the input.

Suffixes are range-partitioned by their leading bytes: a record holds the first `gram` bytes of its
suffix as big-endian 8-byte words, then what tells equal leads apart (digests of the rest of the
strings that the suffix stands for), the document and the place. Splitters are sampled records. Every
bucket is sorted by multikey quicksort over the words: each word sorts only the suffixes that all
words before it have left equal. Neighbours whose words and digests are equal are one run, and all but
the run's first are repeated. A splitter is a real record and the last one of its bucket, so a run
that a boundary cuts is recognised in the next bucket by comparing its first record's content with
the splitter's: runs of any size are spread over as many buckets as they need.

Only the suffixes that can decide something are sorted, in up to three rounds, for all suffixes of all
texts would be some sixteen times the input. First the anchors' suffixes: the leftmost least `gram`-byte
hash of each string picks the suffix that stands for it (equal strings pick the same place), about one
in 38 bytes. A segment is all strings that one suffix stands for; segments with the same content
as an earlier one are repeated as a whole. Where segments share the suffix's leading bytes but differ
in content, they are split into parts of 8 neighbouring strings, aligned at the suffix, and sorted by
what the strings of a part have in common. Parts that share this but differ in content (at the very
ends of repeated passages) are decided string by string. Beyond the lead, content is compared by 64 bits
of a digest of what is common and at least 56 of a digest of all.

Defined cases: null is empty text; texts below `length` bytes lose nothing; of repeated rows (same
id and text) the first is judged and the others are removed, if they have `length` bytes; texts
that share an id are ordered by a hash of the text; null ids come before all others, in the order of
64 bits of their texts' hashes, and equal texts without an id are repeated rows; an empty table gives an
empty result. Ids are integers above -2^62. Two different texts of one id whose 32-bit hashes agree (of null
ids: 94 bits) fail the job rather than lose text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import likely
from .columns import U64, Hasher, flat, frugal, mix, slices
from .staging import drop, partitions, release, staged

LENGTH = 100
GRAM = 24
#: Strings of a part of a segment.
PART = 8
#: Documents whose suffixes give the splitters, and about how many of their records: a bounded sample, which
#: only balances the buckets.
SAMPLE_DOCS, LEAST_SAMPLE, MOST_SAMPLE = 3000, 1 << 17, 1 << 20
#: Records that one bucket is meant to hold at most.
BUCKET_RECORDS = 1 << 19


def words_of(gram: int) -> list[str]:
    """Columns of a suffix's leading bytes."""
    return [f"w{k}" for k in range(-(-gram // 8))]


def keys_of(gram: int) -> list[str]:
    """Columns that records are sorted by: leading words, digests (rest: what strings have in common; whole:
    all of them, with the number of further strings), document, place."""
    return [*words_of(gram), "rest", "whole", "doc", "place"]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w, by blocks of w scanned from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    full = np.append(x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments: anchor position, first and last string start, and the text's number. The gram hashes too."""
    w = length - gram + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.zeros(0, U64)
    at = np.arange(len(data) - gram + 1)
    g = Hasher(data, seed=5)(at, at + gram)
    least = sliding_min(g, w)
    # A gram is the least of some window if it is the greatest of the minima of the windows that hold it.
    most = ~sliding_min(~np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)]), w)
    candidates = np.flatnonzero(g == most)
    doc = np.repeat(np.arange(len(offs) - 1), np.maximum(np.diff(offs) - length + 1, 0))
    starts = np.arange(len(doc)) + (offs[:-1] - np.cumsum(np.append(0, np.maximum(np.diff(offs) - length + 1, 0)))[:-1])[doc]
    if not len(starts):
        return empty, empty, empty, empty, g
    pick = np.searchsorted(candidates, starts)
    todo = np.flatnonzero(g[candidates[pick]] != least[starts])
    while len(todo):
        pick[todo] += 1
        todo = todo[g[candidates[pick[todo]]] != least[starts[todo]]]
    anchor = candidates[pick]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return anchor[first], starts[first], starts[last], doc[first], g


def _lead(data: np.ndarray, at: np.ndarray, gram: int) -> list[np.ndarray]:
    """The suffixes' first `gram` bytes as words that sort, as signed numbers, like the bytes."""
    n = -(-gram // 8)
    raw = np.zeros((len(at), 8 * n), np.uint8)
    raw[:, :gram] = np.lib.stride_tricks.sliding_window_view(data, gram)[at] if len(at) else 0
    words = raw.view(">u8").astype(U64) ^ U64(1 << 63)
    return [np.ascontiguousarray(words[:, k]).view(np.int64) for k in range(n)]


def _place(tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (tie.astype(np.int64) << 32) | start.astype(np.int64)


def more_bits(length: int, gram: int) -> int:
    """Bits at the end of `whole` that hold the number of a segment's further strings."""
    return (length - gram).bit_length()


def sparse_records(b: pa.RecordBatch, length: int, gram: int) -> list[np.ndarray]:
    """Records of the anchors' suffixes."""
    data, offs = flat(b.column("text"))
    anchor, first, last, row, _ = anchors(data, offs, length, gram)
    if not len(anchor):
        return [np.zeros(0, np.int64)] * len(keys_of(gram))
    more = (last - first).astype(U64)
    whole = mix(Hasher(data, seed=6)(first, last + length) + (anchor - first).astype(U64) * U64(0x9E3779B97F4A7C15))
    k2 = ((whole >> U64(more_bits(length, gram)) << U64(more_bits(length, gram))) | more).view(np.int64)
    doc, tie = b.column("doc_id").to_numpy(), b.column("tie").to_numpy()
    return [*_lead(data, anchor, gram), np.zeros(len(anchor), np.int64), k2, doc[row], _place(tie[row], first - offs[row])]


def part_records(b: pa.RecordBatch, length: int, gram: int) -> list[np.ndarray]:
    """Records of the parts of the wanted segments: sorted by their common bytes, told apart by all."""
    bits = more_bits(length, gram)
    data, offs = flat(b.column("text"))
    anchor, first, last, row, _ = anchors(data, offs, length, gram)
    wanted = b.column("segments")
    values, per = np.asarray(wanted.flatten(), np.int64), np.asarray(wanted.value_lengths(), np.int64)
    hit = np.isin(first, (values >> bits) + offs[np.repeat(np.arange(b.num_rows), per)])
    anchor, first, last, row = anchor[hit], first[hit], last[hit], row[hit]
    lo, hi = (anchor - last) // PART, (anchor - first) // PART
    n = hi - lo + 1
    part = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    anchor, first, last, row = (np.repeat(x, n) for x in (anchor, first, last, row))
    core = anchor - PART * part
    start, end = np.maximum(core - PART + 1, first), np.minimum(core, last)
    hasher = Hasher(data, seed=8)
    digest = mix(hasher(core, core - PART + 1 + length) + part.astype(U64) * U64(0x9E3779B97F4A7C15))
    whole = mix(hasher(start, end + length) + (anchor - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    k2 = ((whole >> U64(bits) << U64(bits)) | (end - start).astype(U64)).view(np.int64)
    doc, tie = b.column("doc_id").to_numpy(), b.column("tie").to_numpy()
    return [*_lead(data, core, gram), digest.view(np.int64), k2, doc[row], _place(tie[row], start - offs[row])]


def full_records(b: pa.RecordBatch, length: int, gram: int) -> list[np.ndarray]:
    """Records of the suffixes at every string start of the wanted segments (start << bits | more)."""
    bits = more_bits(length, gram)
    data, offs = flat(b.column("text"))
    wanted = b.column("segments")
    values, per = np.asarray(wanted.flatten(), np.int64), np.asarray(wanted.value_lengths(), np.int64)
    row = np.repeat(np.arange(b.num_rows), per)
    n = (values & ((1 << bits) - 1)) + 1
    row = np.repeat(row, n)
    start = np.repeat(values >> bits, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = start + offs[row]
    digest = Hasher(data, seed=8)(at, at + length)
    k2 = Hasher(data, seed=9)(at, at + length) >> U64(bits) << U64(bits)
    doc, tie = b.column("doc_id").to_numpy(), b.column("tie").to_numpy()
    return [*_lead(data, at, gram), digest.view(np.int64), k2.view(np.int64), doc[row], _place(tie[row], start)]


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """Order by all keys: a quicksort by the first, then each further key sorts only what is still tied."""
    order = np.argsort(keys[0], kind="quicksort")
    value = keys[0][order]
    new = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
    for key in keys[1:]:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True)) if len(new) else new
        if not len(tied):
            break
        run = np.cumsum(new)[tied]
        value = key[order[tied]]
        sub = np.argsort(value, kind="quicksort")
        sub = sub[np.argsort(run[sub], kind="stable")]
        order[tied], value = order[tied[sub]], value[sub]
        new[tied[1:]] |= value[1:] != value[:-1]
    return order


def buckets(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Bucket of each record: the number of splitters below it, so a splitter is the last of its bucket."""
    lo = np.searchsorted(splitters[:, 0], keys[0], "left")
    hi = np.searchsorted(splitters[:, 0], keys[0], "right")
    unsure = np.flatnonzero(hi > lo)
    while len(unsure):  # records between splitters that share their first word: halve what is left
        mid = (lo[unsure] + hi[unsure]) // 2
        s = splitters[mid]
        above, even = np.zeros(len(unsure), bool), np.ones(len(unsure), bool)
        for c, key in enumerate(keys):
            x = key[unsure]
            above |= even & (x > s[:, c])
            even &= x == s[:, c]
        lo[unsure] = np.where(above, mid + 1, lo[unsure])
        hi[unsure] = np.where(above, hi[unsure], mid)
        unsure = unsure[hi[unsure] > lo[unsure]]
    return lo


def _records(frame: DataFrame, make, gram: int, splitters=None, share: float = 1.0) -> DataFrame:
    """Suffix records of frame's texts: with splitters (a broadcast) dealt into their buckets; a share of them
    picked by hash for a sample."""
    names = keys_of(gram)
    out = T.StructType([T.StructField(c, T.LongType()) for c in names])
    if splitters is not None:
        out = out.add("bucket", T.IntegerType())

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                keys = make(b)
                if share < 1:
                    few = mix(keys[-2].view(U64) * U64(3) + keys[-1].view(U64)) < U64(int(share * ((1 << 64) - 1)))
                    keys = [k[few] for k in keys]
                cols = [pa.array(k) for k in keys]
                if splitters is not None:
                    cols.append(pa.array(buckets(keys, splitters.value), pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=out.fieldNames())

    return frame.mapInArrow(frugal(run), out)


def sample_splitters(frame: DataFrame, make, gram: int, in_all: float, in_sample: float, least: int) -> np.ndarray:
    """Real records that cut the sample, and so about all records, into even buckets. in_all, in_sample: about
    how many records there are, and how many of them in the frame."""
    want = int(max(least, in_all // BUCKET_RECORDS + 1))
    most = min(max(LEAST_SAMPLE, 2 * want), MOST_SAMPLE)
    names = keys_of(gram)
    sample = _records(frame, make, gram, share=min(1.0, most / max(1.0, in_sample))).toArrow()
    keys = [np.asarray(sample.column(c).combine_chunks(), np.int64) for c in names]
    if not len(keys[0]):
        return np.zeros((0, len(names)), np.int64)
    n = min(want, len(keys[0]))
    order = multikey_quicksort(keys)
    at = order[np.unique(np.arange(1, n) * len(order) // n)]
    table = np.stack([k[at] for k in keys], axis=1)
    if not len(table):
        return table
    new = np.append(True, (table[1:] != table[:-1]).any(axis=1))
    return table[new]


_SORTED = T.StructType().add("kind", T.IntegerType()).add("doc", T.LongType()).add("place", T.LongType()).add("more", T.IntegerType())
_REPEATED, _UNDECIDED = 0, 1


def sorted_suffixes(records: DataFrame, gram: int, splitters, bits: int, sparse: bool) -> DataFrame:
    """Per bucket: repeated records (kind 0) and, when sparse, the first records of segments that
    share what they are sorted by with others of another content (kind 1). more: further strings of the segment."""
    names = keys_of(gram)
    lead = len(words_of(gram)) + 1  # the leading words and `rest`
    last = (1 << bits) - 1

    def run(batches):
        held = [[np.asarray(b.column(c), np.int64) for c in (*names, "bucket")] for b in batches if b.num_rows]
        if not held:
            return
        cols = []
        for i in range(len(names) + 1):
            cols.append(np.concatenate([h[i] for h in held]))
            for h in held:
                h[i] = None
        cuts, found = splitters.value, np.unique(cols[-1]).tolist()
        for bucket in found:  # one, unless the runtime has put small ones together
            keys = cols[:-1] if len(found) == 1 else [c[cols[-1] == bucket] for c in cols[:-1]]
            order = multikey_quicksort(keys)
            keys = [k[order] for k in keys]
            whole, doc, place = keys[-3:]
            group = np.zeros(len(order), bool)
            group[0] = True
            for k in keys[:lead]:
                group[1:] |= k[1:] != k[:-1]
            new = group.copy()
            new[1:] |= whole[1:] != whole[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            repeated = ~new & ~((doc == doc[head]) & (place == place[head]))
            fresh = new.copy()
            below = cuts[bucket - 1] if bucket else None
            above = cuts[bucket] if bucket < len(cuts) else None
            if below is not None and all(k[0] == x for k, x in zip(keys[: lead + 1], below)):
                # The run began in an earlier bucket; the splitter is one of its records there.
                repeated |= head == 0
                fresh[0] = False
            out = [(_REPEATED, repeated)]
            if sparse:
                number = np.cumsum(group) - 1
                many = np.bincount(number, weights=new)[number] > 1
                for edge in (below, above):
                    if edge is not None:
                        same = np.ones(len(order), bool)
                        for k, x in zip(keys[:lead], edge):
                            same &= k == x
                        many |= same
                out.append((_UNDECIDED, fresh & many))
            for kind, pick in out:
                d, p, m = doc[pick], place[pick], whole[pick] & last
                for i in range(0, len(d), 50_000):
                    s = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d[s]), kind), pa.int32()), pa.array(d[s]), pa.array(p[s]), pa.array(m[s], pa.int32())], names=_SORTED.fieldNames())

    return records.repartitionById(len(splitters.value) + 1, F.col("bucket")).mapInArrow(frugal(run), _SORTED)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """kind, doc, place (tie << 32 | first string's start), more: the repeated strings. docs: doc_id, tie, text."""
    spark = docs.sparkSession
    least, bits = partitions(spark), more_bits(length, gram)
    share_cuts = spark.sparkContext.broadcast
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("double")), F.lit(0.0))).first()
    every = max(1, total // SAMPLE_DOCS)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(every)) == 0
    seen = docs.filter(chosen).agg(F.coalesce(F.sum(F.octet_length("text").cast("double")), F.lit(0.0))).first()[0] if every > 1 else size
    per_byte = 2 / (length - gram + 2)
    make = lambda b: sparse_records(b, length, gram)
    cut = share_cuts(sample_splitters(docs.filter(chosen), make, gram, size * per_byte, seen * per_byte, least))
    first = staged(sorted_suffixes(_records(docs, make, gram, cut), gram, cut, bits, True), "sparse")
    release(spark)
    tie, start = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))

    def decided(before: DataFrame, make, last: bool, name: str) -> DataFrame:
        """The next round, over the texts that hold something undecided."""
        undecided = before.filter(F.col("kind") == _UNDECIDED)
        wanted = undecided.groupBy(F.col("doc").alias("doc_id"), tie.alias("tie")).agg(F.collect_list(F.shiftleft(start, bits).bitwiseOR(F.col("more").cast("long"))).alias("segments"), F.sum(F.col("more") + 1).cast("double").alias("strings"))
        wanted = staged(wanted, "wanted")
        number = F.coalesce(F.sum("strings"), F.lit(0.0))
        in_all = wanted.agg(number).first()[0]
        in_sample = wanted.filter(chosen).agg(number).first()[0]
        held = likely(docs, "doc_id", wanted, "doc_id").join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "text", "segments")
        each = 1 if last else 2 / PART
        cut = share_cuts(sample_splitters(held.filter(chosen), make, gram, in_all * each, in_sample * each, least))
        out = staged(sorted_suffixes(_records(held, make, gram, cut), gram, cut, bits, not last), name)
        drop(wanted)
        release(spark)
        return out

    second = decided(first, lambda b: part_records(b, length, gram), False, "parts")
    third = decided(second, lambda b: full_records(b, length, gram), True, "full")
    repeated = F.col("kind") == _REPEATED
    return first.filter(repeated).union(second.filter(repeated)).union(third)


#: Places of null ids: below all ids, each text's own.
_NAMELESS = 1 << 62


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the remaining
    bytes; as_text a string: these without characters that a cut has broken), and the columns named in
    carry, in a struct `carried` if there are any."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    nameless = F.lit(-(1 << 63)) + F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit(_NAMELESS - 1))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), nameless).alias("doc_id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tie"), text.alias("text"), docs[id_col].isNotNull().alias("named"), *([F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []))
    spans = repeated_spans(rows.select("doc_id", "tie", "text"), length, gram)
    at = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    spans = spans.select(F.col("doc").alias("doc_id"), F.shiftright("place", 32).cast("int").alias("tie"), F.lit(0).alias("kind"), at.alias("start"), (at + F.col("more") + length).alias("end"), F.lit(None).cast("string").alias("text"))
    whole = rows.withColumns({"kind": F.lit(1), "start": F.lit(0).cast("long"), "end": F.lit(0).cast("long")})
    both = spans.unionByName(whole, allowMissingColumns=True)
    both = both.select("doc_id", "tie", "kind", "start", "end", "text", "named", *(["carried"] if carry else []))
    both = both.repartition(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "kind", "start")
    out = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = out.add("kept", T.StringType() if as_text else T.BinaryType())
    if carry:
        out = out.add(rows.schema["carried"])

    def run(batches):
        now, starts, ends, judged = None, [], [], None
        for b in batches:
            doc, tie, kind = (b.column(c).to_numpy() for c in ("doc_id", "tie", "kind"))
            start, end = b.column("start").to_numpy(), b.column("end").to_numpy()
            edges = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (kind[1:] != kind[:-1]))).tolist() if len(doc) else []
            rows_, index = [], []
            for i, j in zip(edges, [*edges[1:], len(doc)]):
                if (doc[i], tie[i]) != now:
                    now, starts, ends, judged = (doc[i], tie[i]), [], [], None
                if kind[i] == 0:
                    starts.append(start[i:j])
                    ends.append(end[i:j])
                    continue
                for k in range(i, j):
                    raw = b.column("text")[k].as_buffer()
                    own = hashlib.sha256(raw).digest()
                    if judged not in (None, own):
                        raise RuntimeError("two texts of one id share a hash; give them ids of their own")
                    index.append(k)
                    rows_.append(_cut(int(doc[k]) if b.column("named")[k].as_py() else None, raw, starts, ends, length, judged is not None))
                    judged = own
            if rows_:
                *digest, kept = zip(*rows_)
                cols = [pa.array(c, t) for c, t in zip(digest, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                cols.append(pa.array([x.decode("utf-8", "ignore" if cut else "replace") for x, cut in zip(kept, digest[2])] if as_text else kept, pa.string() if as_text else pa.binary()))
                yield pa.RecordBatch.from_arrays([*cols, *([b.column("carried").take(pa.array(index))] if carry else [])], names=out.fieldNames())

    return both.mapInArrow(frugal(run), out)


def _cut(doc: int | None, raw, starts: list[np.ndarray], ends: list[np.ndarray], length: int, again: bool) -> tuple:
    n = len(raw)
    if again and n >= length:
        return doc, n, n, 1, hashlib.sha256(b"").hexdigest(), b""
    if not starts:
        return doc, n, 0, 0, hashlib.sha256(raw).hexdigest(), raw.to_pybytes()
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    head = np.append(True, s[1:] > e[:-1])
    s, e = s[head], e[np.append(np.flatnonzero(head)[1:] - 1, len(e) - 1)]
    view, at, kept = memoryview(raw), 0, []
    for i, j in zip(s.tolist(), e.tolist()):
        kept.append(view[at:i])
        at = j
    kept = b"".join([*kept, view[at:]])
    return doc, n, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept
