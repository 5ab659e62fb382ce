"""Importance resampling towards a target's n-gram distribution, over a dictionary of distinct features.

Texts are cut into words and runs of words in tasks, a chunk of texts at a time: a chunk keeps its distinct features once,
as strings with their counts, and for each document the places of its features in that list with theirs. Then
1. chunks' features are counted globally, combined map-side: the dictionary, one row a distinct string;
2. each distinct string is hashed once, to its bucket, and counts are summed by bucket, for documents and target alike;
3. a bucket's gain is the scaled logarithm of its two frequencies' ratio, smoothed by one;
4. gains are joined to the dictionary and through it to each chunk's list of features, and lists go back to the chunk's per-document counts,
   whose floored mean gain is the document's weight;
5. a seeded Gumbel number is added to the weight, and the highest scores are drawn: without replacement, in proportion to the weights' exponentials.
Texts are shuffled never, strings once per chunk however often they are used, so a frequent word or a source with a third of all rows is no
large task. Only the gains' table is broadcast, as many rows as there are buckets (a parameter). Ranks come from a range partitioning by score
with counts of partitions before it, so no task sorts all documents.

Defined cases: a null or empty text, or one without a word, has no features and weight 0, and isn't drawn unless min_words is 0; a null id draws
its number as an empty string; rows that repeat an id or a text are documents of their own, with equal scores where ids are equal, and rank
in the order of the rows; ties go to the smaller id, nulls first; an empty table gives an empty result, and an empty target gains from smoothing alone;
columns other than the named ones are not read, whatever their names. Long texts are chunks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import LOWER, as_strings, flat, frugal, ranges
from .staging import drop, partitions, staged

#: Text bytes of a chunk.
CHUNK_BYTES = 4 << 20
#: Bytes of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
INK = np.ones(256, bool)
INK[0x00:0x30] = INK[0x3A:0x61] = INK[0x7B:0x80] = False


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space between two: bytes, where each word starts (and the end), words before each text."""
    low = LOWER[data]
    ink = INK[low]
    head, tail = np.append(True, ~ink[:-1])[: len(ink)], np.append(~ink[1:], True)[: len(ink)]
    head[offs[:-1][offs[:-1] < len(ink)]] = True
    tail[offs[1:][offs[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(ink & head), np.flatnonzero(ink & tail) + 1
    out = np.full(int((ends - starts).sum()) + len(starts), 0x20, np.uint8)
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out[ranges(at[:-1], ends - starts)] = low[ranges(starts, ends - starts)]
    return out, at, np.searchsorted(starts, offs)


def features(data: np.ndarray, offs: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All runs of 1 to most words of each text, as strings, the text of each, and the words of each text."""
    words, at, per = _words(data, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(per))
    left = per[1:][text] - np.arange(len(text))  # words from here to the end of the text
    starts, lens, owner = [], [], []
    for n in range(1, most + 1):
        i = np.flatnonzero(left >= n)
        starts.append(at[i])
        lens.append(at[i + n] - 1 - at[i])
        owner.append(text[i])
    starts, lens = np.concatenate(starts), np.concatenate(lens)
    return as_strings(words[ranges(starts, lens)], np.concatenate([[0], np.cumsum(lens)])), np.concatenate(owner), np.diff(per)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64) if n else np.zeros(0, np.int64)


def _chunk(ids: pa.Array, texts: pa.Array, most: int, names: list[str]) -> pa.RecordBatch:
    data, offs = flat(texts)
    found, owner, words = features(data, offs, most)
    coded = found.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    held, counts = np.unique(owner * size + codes, return_counts=True)  # a document's features, its documents in order
    per = np.bincount(held // size, minlength=len(texts))
    totals = np.bincount(codes, minlength=len(coded.dictionary))
    cols = [
        pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([totals], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.array([words], pa.list_(pa.int64())), pa.array([len(held)], pa.int64()), pa.array([_pack(per)]), pa.array([_pack(held % size)]), pa.array([_pack(counts)]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=names)


def chunks(docs: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """One staged row per chunk: its number, features and totals, and of its documents ids, words and packed counts per feature."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = T.StructType.fromDDL(f"features array<string>, totals array<long>, ids array<{kind}>, n_words array<long>, n_held long, per binary, held binary, counts binary")
    names = out.fieldNames()

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            _, offs = flat(b.column("text"))
            i = 0
            while i < b.num_rows:  # rows until the chunk is full, one at least
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES - size, "right")) - 1)
                ids.append(b.column("id").slice(i, j - i))
                texts.append(b.column("text").slice(i, j - i))
                size, i = size + int(offs[j] - offs[i]), j
                if size >= CHUNK_BYTES or i < b.num_rows:
                    yield _chunk(pa.concat_arrays(ids), pa.concat_arrays(texts), most, names)
                    ids, texts, size = [], [], 0
        if ids:
            yield _chunk(pa.concat_arrays(ids), pa.concat_arrays(texts), most, names)

    return staged(src.mapInArrow(frugal(run), out).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def dictionary(parts: DataFrame, buckets: int) -> DataFrame:
    """The staged dictionary: each distinct feature of the chunks once, its count and its bucket."""
    each = parts.select(F.explode(F.arrays_zip("features", "totals")).alias("x")).select("x.features", "x.totals")
    counted = each.groupBy(F.col("features").alias("feature")).agg(F.sum("totals").alias("n"))
    return staged(counted.withColumn("bucket", F.crc32("feature") % buckets), "dictionary")


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain (long) of all buckets, from two dictionaries."""
    s, t = (x.groupBy("bucket").agg(F.sum("n").alias(c)) for x, c in ((source, "s"), (target, "t")))
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = (float(n) for n in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1.0) * (all_s + buckets) / ((F.col("s") + 1.0) * (all_t + buckets))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """Staged, one row per document: row (unique), id, n_words, n_features, weight."""
    parts, wanted = chunks(docs, most, id_col, text_col), chunks(target, most, target_id, target_text)
    known, aimed = dictionary(parts, buckets), dictionary(wanted, buckets)
    gain = staged(gains(known, aimed, buckets), "gains")
    priced = known.join(F.broadcast(gain), "bucket").select("feature", "gain")
    each = parts.select("chunk", F.posexplode("features").alias("place", "feature"))
    lists = each.join(priced, "feature").groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "gain"))), lambda x: x["gain"]).alias("gains"))
    full = parts.drop("features", "totals").join(lists, "chunk", "left")
    out = T.StructType().add("id", parts.schema["ids"].dataType.elementType).add("n_words", T.LongType()).add("n_features", T.LongType()).add("weight", T.LongType())

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(c)[r] for c in b.schema.names}
                ids, held = one["ids"].values, one["n_held"].as_py()
                per = _unpack(one["per"].as_py(), len(ids))
                place, count = (_unpack(one[c].as_py(), held) for c in ("held", "counts"))
                gain = one["gains"].values.to_numpy(zero_copy_only=False) if held else np.zeros(0, np.int64)
                ends = np.cumsum(per)
                n, sums = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (count, gain[place] * count))
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)  # integers: the floor is exact
                yield pa.RecordBatch.from_arrays([ids, one["n_words"].values, pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=out.fieldNames())

    done = staged(full.mapInArrow(frugal(run), out).withColumn("row", F.monotonically_increasing_id()), "weights")
    drop(parts, wanted, known, aimed, gain)
    return done


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """id_col, n_features, weight, score, rank (from 1; null where not drawn) of every document. Of those with at least min_words
    words, percent in a hundred are drawn."""
    spark = docs.sparkSession
    rows = weights(docs, target, most, buckets, id_col, text_col, target_id, target_text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.withColumn("score", F.col("weight") + noise)
    fit = rows.filter(F.col("n_words") >= min_words)
    # Sorted partitions in the order of scores: a row's number in its partition, after the rows of the partitions before it.
    order = (F.desc("score"), F.asc_nulls_first("id"), F.asc("row"))
    by_score = fit.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    by_score = staged(by_score.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    sizes = sorted((r["part"], r["count"]) for r in by_score.groupBy("part").count().collect())  # a number for each partition
    drawn, before, rank = sum(n for _, n in sizes) * percent // 100, 0, F.lit(None).cast("long")
    firsts = []
    for part, n in sizes:
        firsts.append((part, before))
        before += n
    if firsts:
        at = spark.createDataFrame(firsts, "part int, first long")
        by_score = by_score.join(F.broadcast(at), "part")  # as many rows as partitions
        rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        rank = F.when(rank <= drawn, rank)
    names = (F.col("id").alias(id_col), "n_features", "weight", "score")
    rest = rows.filter(~(F.col("n_words") >= min_words)).select(*names, F.lit(None).cast("long").alias("rank"))
    return by_score.select(*names, rank.alias("rank")).union(rest)
