"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams; two link when their sets' Jaccard similarity is at
least num/den. Equal sets are one class from the start. The n-grams have one global order, rare
ones first, by a fixed-size table of counts over all documents.

Candidates: a pair that links shares an n-gram within both sets' prefixes. Within each n-gram's
group the member that has it earliest is the pivot, and only (pivot, member) pairs are compared, as
far as lengths and positions allow a link: linear in the group. What these links join needs no
further comparison. The members that they leave outside of their pivot's component are compared with
those of the group that are in another component, so no link between components is lost and nearly
equal texts are not compared pair by pair. A group of more than HOT members of several components is
split first, by the next n-gram that a pair shares: different sets that link share at least
num / (den - num) n-grams, and the first k of these lie within prefixes that are k - 1 longer. So
unlike texts that share one n-gram fall apart instead of meeting each other.

A pair is dropped before its sets are compared only by a bound that holds: each set has a parity
signature, a bit per hash bucket, and two signatures differ in no more bits than their sets differ
in n-grams.

Verification: pivots cut the global order into fragments of about equal weight; each fragment
counts the partial overlap of its pairs by itself, and the sum per pair is the exact overlap.

Defined cases: null, empty or white text has no n-grams and links with nothing; texts of fewer than
n words are one n-gram, their whole sequence; repeated rows and equal sets are linked; rows
with a null doc_id take no part and have a null component; an empty table gives an empty result. Columns other
than id and text are not read. n-grams are told apart by 64-bit hashes, sets by two such sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import LOWER, U64, Hasher, flat, frugal, mix, ranges, slices, spans
from .bloom import likely, parted
from .components import components
from .staging import drop, partitions, release, staged

#: Slots of the table of n-gram counts: bounded, whatever the corpus.
SLOTS = 1 << 20
_BLOCK = 1 << 16
FRAGMENTS = 8
#: 64-bit words of a parity signature.
PARITY_WORDS = 16
#: Members of a group of several components that are compared with each other; larger groups are split.
HOT = 64
#: n-grams by which groups are split at most.
MOST_LEVELS = 4
_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and their offsets per text."""
    data, offs = flat(texts)
    starts, ends, at = spans(LOWER[data], offs)
    words = Hasher(LOWER[data], seed=3)(starts, ends)
    count = np.diff(at)
    total = len(words)
    grams = np.zeros(total, U64)
    for j in range(n):
        if total > j:
            grams[: total - j] += words[j:] * _C[j % 8]
    keep = np.ones(total, bool)
    for j in range(1, n):  # no n-gram starts at the last n - 1 words of a text
        tail = at[1:] - j
        keep[tail[(count >= j)]] = False
    short = (count > 0) & (count < n)
    for m in range(1, n):
        first = at[:-1][short & (count == m)]
        if len(first):
            keep[first] = True
            grams[first] = np.sum([words[first + j] * _C[j % 8] for j in range(m)], axis=0, dtype=U64) + U64(m) * _C[7] + U64(1)
    grams = mix(grams[keep])
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])) if len(grams) else np.zeros(0, bool)
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(per) + 1))


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Documents per slot of n-gram hashes, over all documents."""
    spark = docs.sparkSession
    pair = T.StructType().add("block", T.IntegerType()).add("shard", T.IntegerType()).add("counts", T.BinaryType())

    shards = max(1, partitions(spark) // 16)

    def rows(totals: dict, shard: int):
        packed = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in totals.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([shard] * len(packed), pa.int32()), pa.array(packed, pa.binary())], names=["block", "shard", "counts"])

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                grams, _ = shingles(b.column("text"), n)
                total += np.bincount((grams % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
        if total.any():
            yield rows(dict(enumerate(total.reshape(-1, _BLOCK))), TaskContext.get().partitionId() % shards)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("block").to_pylist(), b.column("counts")):
                x = np.frombuffer(pa.decompress(v.as_buffer(), _BLOCK * 8, codec="zstd"), np.int64)
                total[k] = total[k] + x if k in total else x
        if total:
            yield rows(total, 0)

    # As a tree: each task's counts are added up by block and shard before the shards are.
    out = np.zeros(SLOTS, np.int64).reshape(-1, _BLOCK)
    some = docs.mapInArrow(frugal(count), pair).repartition(min(16 * shards, partitions(spark)), "block", "shard").mapInArrow(frugal(add), pair)
    for r in some.repartition(min(16, partitions(spark)), "block").mapInArrow(frugal(add), pair).collect():
        out[r["block"]] = np.frombuffer(pa.decompress(r["counts"], _BLOCK * 8, codec="zstd"), np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def order_key(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of n-grams in the global order."""
    return (counts[(grams % U64(SLOTS)).astype(np.int64)].astype(np.int64) << 32) | (grams >> U64(32)).astype(np.int64)


def fragment_bounds(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments of about equal weight."""
    value, slots = np.unique(counts[counts > 0], return_counts=True)
    if not len(value):
        return np.zeros(0, np.int64)
    weight = np.cumsum(value.astype(float) * slots)
    want = weight[-1] * np.arange(1, fragments) / fragments
    k = np.searchsorted(weight, want)
    before = np.append(0, weight)[k]
    part = np.clip((want - before) / np.maximum(weight[k] - before, 1), 0, 1)
    return (value[k].astype(np.int64) << 32) | (part * ((1 << 32) - 1)).astype(np.int64)


def _ordered(grams: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = order_key(grams, counts)
    order = np.lexsort((grams, key, doc))
    return grams[order], key[order]


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def _nodes(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever its order."""
    one = mix(_sums(mix(grams + U64(1)), at) + np.diff(at).astype(U64) * _C[1]).view(np.int64)
    return one, mix(_sums(mix(grams ^ _C[2]), at) + np.diff(at).astype(U64) * _C[3]).view(np.int64)


def _parity(grams: np.ndarray, at: np.ndarray) -> pa.Array:
    """Parity of the n-grams in each of the hash buckets, as 64-bit words."""
    bit = mix(grams + U64(2)) % U64(64 * PARITY_WORDS)
    out = np.zeros((len(at) - 1, PARITY_WORDS), U64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(at) - 1), np.diff(at)), (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * PARITY_WORDS, pa.int32()), pa.array(out.ravel().view(np.int64)))


def most_levels(num: int, den: int) -> int:
    """n-grams that two different sets share at least if they link, as far as groups are split by them."""
    return max(1, min(MOST_LEVELS, num // (den - num))) if num < den else 1


def sets_of(docs: DataFrame, counts, n: int, num: int, den: int) -> DataFrame:
    """doc_id, size, node and other (hashes of the set), keep (length of the prefix that a link needs), prefix (that
    many of its rarest n-grams, and as many more as groups may be split by), parity."""
    more = most_levels(num, den) - 1
    out = T.StructType().add(docs.schema["doc_id"]).add("size", T.LongType()).add("node", T.LongType()).add("other", T.LongType()).add("keep", T.IntegerType()).add("prefix", T.ArrayType(T.LongType())).add("parity", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                grams, at = shingles(b.column("text"), n)
                size = np.diff(at)
                node, other = _nodes(grams, at)
                ordered, _ = _ordered(grams, at, counts.value)
                keep = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                long = np.minimum(keep + more, size)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)]), pa.int32()), pa.array(ordered[ranges(at[:-1], long)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(node), pa.array(other), pa.array(keep, pa.int32()), prefix, _parity(grams, at)], names=out.fieldNames())

    return docs.mapInArrow(frugal(run), out)


def segments_of(docs: DataFrame, counts, bounds: np.ndarray, n: int) -> DataFrame:
    """node, fragment, grams: each set's n-grams by fragment of the global order. docs: node, text;
    texts whose set is another (rows that share an id) are left out."""
    out = T.StructType().add("node", T.LongType()).add("fragment", T.IntegerType()).add("grams", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                grams, at = shingles(b.column("text"), n)
                ordered, key = _ordered(grams, at, counts.value)
                doc = np.repeat(np.arange(b.num_rows), np.diff(at))
                part = np.searchsorted(bounds, key, "right")
                edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]))) if len(doc) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(doc)), pa.int32()), pa.array(ordered.view(np.int64)))
                rows = pa.RecordBatch.from_arrays([b.column("node").take(pa.array(doc[edge])), pa.array(part[edge], pa.int32()), lists], names=out.fieldNames())
                one, other = _nodes(grams, at)
                node = b.column("node").to_numpy()
                yield rows.filter(pa.array(((one == node) | (other == node))[doc[edge]]))

    return docs.mapInArrow(frugal(run), out)


class Join:
    """One run of the join: counts, sets, candidates, links, components."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, fragments: int = FRAGMENTS):
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.n, self.num, self.den = docs, n, num, den
        counts = gram_counts(docs, n)
        self.bounds = fragment_bounds(counts, fragments)
        self.counts = self.spark.sparkContext.broadcast(counts)
        self.sets = staged(sets_of(docs, self.counts, n, num, den), "sets")
        # Different sets of one hash go by their other one.
        alike = self.sets.filter("size > 0").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi").select("node")
        alike = staged(alike, "alike")
        if not alike.isEmpty():
            named = self.sets.join(alike.withColumn("alike", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("alike"), F.col("other")).otherwise(F.col("node")))
            named, old = staged(named.select(*self.sets.columns), "sets"), self.sets
            self.sets = named
            drop(old)
        drop(alike)

    def can_link(self, left: str, right: str):
        """Lengths and the places of a shared n-gram leave room for the overlap that a link needs."""
        small, large = F.least(f"{left}size", f"{right}size"), F.greatest(f"{left}size", f"{right}size")
        room = F.least(F.col(f"{left}size") - F.col(f"{left}pos"), F.col(f"{right}size") - F.col(f"{right}pos"))
        return (self.den * small >= self.num * large) & ((self.num + self.den) * room >= self.num * (small + large))

    def groups(self) -> DataFrame:
        """gram, node, size, pos, and the pivot's pnode, psize, ppos, of n-grams in two prefixes or more."""
        classes = self.sets.filter("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("keep").alias("keep"), F.first("prefix").alias("prefix"))
        self.classes = classes = staged(classes, "classes")
        each = classes.select("node", F.col("size").cast("int").alias("size"), F.posexplode(F.slice("prefix", F.lit(1), F.col("keep"))).alias("pos", "gram"))
        # First which n-grams have more than one set, on packed numbers; most have not and go no further.
        packed = F.shiftleft(F.col("pos").cast("long"), 40) + F.shiftrightunsigned("node", 24)
        shared = each.groupBy("gram").agg(F.min(packed).alias("first"), F.count("*").alias("n")).filter("n > 1").select("gram", "first")
        shared = staged(shared, "shared")
        each = likely(each, "gram", shared, "gram").join(shared, "gram").withColumn("pivot", packed == F.col("first")).drop("first")
        each = staged(each, "members")
        pivots = each.filter("pivot").groupBy("gram").agg(F.min(F.struct("node", "size", "pos")).alias("p"))
        pivots = pivots.select("gram", F.col("p.node").alias("pnode"), F.col("p.size").alias("psize"), F.col("p.pos").alias("ppos"))
        out = staged(each.drop("pivot").join(pivots, "gram"), "groups")
        drop(shared, each)
        return out

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose parity signatures allow a link."""
        parity = self.sets.filter("size > 0").groupBy("node").agg(F.first("parity").alias("parity"))
        pairs = pairs.join(parity.select(F.col("node").alias("a"), F.col("parity").alias("pa")), "a").join(parity.select(F.col("node").alias("b"), F.col("parity").alias("pb")), "b")
        differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        most = F.floor((F.col("na") + F.col("nb") - differ) / 2)
        return pairs.filter((self.num + self.den) * most >= self.num * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs (a, b, na, nb) that link: partial overlaps by fragment, summed per pair."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        owner = self.sets.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node")
        owner = staged(owner, "owners")
        texts = owner.join(likely(self.docs, "doc_id", owner, "doc_id"), "doc_id").select("node", "text")
        segments = staged(segments_of(texts, self.counts, self.bounds, self.n).dropDuplicates(["node", "fragment"]), "segments")
        left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
        right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
        partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("k"))
        total = partial.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        out = staged(total.filter((self.num + self.den) * F.col("k") >= self.num * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
        drop(segments, owner)
        return out

    def components(self) -> DataFrame:
        """node, component over all links."""
        groups = self.groups()
        release(self.spark)
        star = groups.filter(F.col("node") != F.col("pnode")).filter(self.can_link("", "p"))
        star = star.select(F.col("node").alias("a"), F.col("pnode").alias("b"), F.col("size").alias("na"), F.col("psize").alias("nb"))
        star = staged(self.possible(_pairs(star)), "pairs")
        links = self.verified(star)
        release(self.spark)
        first = staged(components(links), "components")
        # What the pivots' links leave apart.
        comp = first.select("node", "component")
        of = groups.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of = staged(of.select(F.col("gram").alias("key"), "node", "size", "pos", "component"), "members")
        drop(groups)
        met, used = self.apart(of)
        rest = staged(self.possible(_pairs(met)).join(star.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        drop(of, *used, self.classes)
        if rest.isEmpty():
            drop(star, rest)
            return first
        more = self.verified(rest)
        release(self.spark)
        second = staged(components(links.union(more)), "components")
        drop(star, rest, first, links, more)
        return second

    def apart(self, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Pairs (a, b, na, nb) of different components that a link is possible for, from groups (key, node,
        size, pos, component), and the tables they are read from. A pair that links passes at the first
        n-grams it shares, where one of the two is outside the main component or both are."""
        pairs, used = None, []
        levels = most_levels(self.num, self.den)
        for level in range(1, levels + 1):
            kinds = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", F.struct("pos", "node")).alias("main"), F.count("*").alias("members"))
            mixed = staged(rows.join(kinds.filter("lo <> hi").select("key", "main", "members"), "key"), "mixed")
            used.append(mixed)
            hot = mixed.filter(F.col("members") > HOT)
            if level == levels or hot.isEmpty():
                return _both(pairs, self.met(mixed, level)), used
            # By the next n-gram a pair shares, where that makes less than half as many pairs.
            longer = F.slice("prefix", F.lit(1), F.col("keep") + level)
            tails = hot.select("key", "members", "node", "size", F.col("pos").alias("at"), "component").join(self.classes.select("node", "keep", "prefix"), "node")
            tails = tails.select("key", "members", "node", "size", "at", "component", F.posexplode(longer).alias("pos", "gram")).filter(F.col("pos") > F.col("at"))
            split = staged(tails.select(F.col("key").alias("parent"), F.xxhash64("key", "gram").alias("key"), "members", "node", "size", "pos", "component"), "members")
            cost = split.groupBy("parent", "key").agg(F.count("*").alias("n"), F.max("members").alias("members")).groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("cost"), F.max("members").alias("members"))
            worse = staged(cost.filter("2 * cost >= members * members").select("parent"), "worse")
            used += [split, worse]
            left = mixed.join(worse, mixed["key"] == worse["parent"], "left_semi").filter(F.col("members") > HOT)
            pairs = _both(pairs, self.met(mixed.filter(F.col("members") <= HOT).union(left), level))
            rows = split.join(worse, "parent", "left_anti").select("key", "node", "size", "pos", "component")
        raise AssertionError

    def met(self, mixed: DataFrame, level: int) -> DataFrame:
        """Pairs within groups, of which one is outside the main component."""
        pos = (F.col("pos") - (level - 1)).alias("pos")  # level - 1 shared n-grams come before this one
        each = mixed.select("key", "node", "size", pos, "component")
        x = mixed.filter("component <> main").select("key", F.col("node").alias("xnode"), F.col("size").alias("xsize"), pos.alias("xpos"), F.col("component").alias("xcomponent"))
        met = each.join(x, "key").filter((F.col("component") != F.col("xcomponent")) & self.can_link("", "x"))
        return met.select(F.col("node").alias("a"), F.col("xnode").alias("b"), F.col("size").alias("na"), F.col("xsize").alias("nb"))


def _both(one: DataFrame | None, other: DataFrame) -> DataFrame:
    return other if one is None else one.union(other)


def _pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, a < b."""
    p = pairs.select(F.struct("a", "na").alias("x"), F.struct("b", "nb").alias("y"))
    lo, hi = F.when(F.col("x.a") < F.col("y.b"), F.struct(F.col("x.a").alias("k"), F.col("x.na").alias("n"))).otherwise(F.struct(F.col("y.b").alias("k"), F.col("y.nb").alias("n"))), F.when(F.col("x.a") < F.col("y.b"), F.struct(F.col("y.b").alias("k"), F.col("y.nb").alias("n"))).otherwise(F.struct(F.col("x.a").alias("k"), F.col("x.na").alias("n")))
    return p.select(lo.alias("lo"), hi.alias("hi")).select(F.col("lo.k").alias("a"), F.col("hi.k").alias("b"), F.col("lo.n").alias("na"), F.col("hi.n").alias("nb")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    every = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    join = Join(every.filter("doc_id is not null"), n, num, den)
    comp = join.components()
    sets = join.sets.select("doc_id", F.col("size").alias("n_shingles"), "node")
    named = sets.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = named.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    shared = named.join(least.filter("members > 1"), "component").select("node", "component_id")
    out = sets.join(shared, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))
    nameless = sets_of(every.filter("doc_id is null"), join.counts, n, num, den)
    out = staged(out.union(nameless.select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "verdict")
    drop(join.sets)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs of which one document of each group stays: the one that names the group, and
    of repeated rows with its id the first by text. Rows with a null id all stay. Other columns may
    have any names. Only rows that may go, or whose id is repeated, are shuffled with their texts."""
    verdict = jaccard_components(docs, id_col, text_col, n, num, den)
    per = verdict.filter("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("rows"))
    once, often = (per.filter(c).select("doc_id") for c in ("kept = 1", "kept > 1"))
    # Most documents stay, and no row has their id but theirs: those are passed on without a shuffle.
    doubtful, sure = parted(docs.filter(docs[id_col].isNotNull()), id_col, per.filter("kept <> 1 or rows <> 1").select("doc_id"), "doc_id")
    alone = doubtful.join(once, doubtful[id_col] == once["doc_id"], "left_semi")
    repeated = doubtful.join(often, doubtful[id_col] == often["doc_id"], "left_semi").select(F.struct(*(doubtful[c] for c in docs.columns)).alias("row"))
    order = F.struct(F.col("row").getField(text_col), F.xxhash64(F.to_json("row")))
    first = repeated.groupBy(F.col("row").getField(id_col).alias("id")).agg(F.min_by("row", order).alias("row"))
    first = first.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return sure.union(alone).union(first).union(docs.filter(docs[id_col].isNull()))
