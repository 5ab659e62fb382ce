"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length one, so a cosine of at least c is a distance of at most R = sqrt(2 - 2c). Equal vectors of a label are
one class with a count. Then
1. a coarse quantiser (k-means) and codes of residuals by subspace (k-means in each) are fitted on a bounded sample, SAMPLE vectors at most;
2. every class goes to the inverted list of its nearest centroid, with its residual's code and the length e of what the code leaves;
3. it probes the lists whose bisecting plane is at most R / 2 away. These probes are sufficient: if x and y within R lie in different lists, both
   distances to the plane between sum to R at most, so one of them finds the other's list; found both ways, the pair counts where the list has
   the higher number;
4. in a list, tables of squared distances from the probing residual to each subspace's centroids are looked up with the members' codes
   (asymmetric distances); a member stays if that is at most R + e, which no y within R exceeds, by the triangle inequality;
5. those pairs get their exact cosine in double precision. So recall doesn't depend on how well the quantisers fit, only the work does.

Scale: lists are kept per label and length of vector. Members come before their probes in a sorted partition, and probes stream past them. A list with n
classes is dealt in about sqrt(n / SPREAD) blocks, each of which meets all of the list's probes, so neither a task's memory nor the copies of a
vector grow with a hot list as a whole. Links of a hot group aren't written as pairs: a task adds counts per vector and passes on a
spanning forest of what it links. The quantisers that tasks get hold MOST_LISTS + 256 centroids at most. Beyond some LIST_SIZE * MOST_LISTS
vectors lists grow with the table.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and those with a null label, link with nothing;
vectors of different lengths don't either; a null id counts as a vector but names no component unless all its ids are null; rows that repeat an id
are vectors of their own; an empty table gives an empty result; columns other than the named ones are not read.
Equal vectors of a label meet by two 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import frugal
from .components import components
from .staging import drop, partitions, staged

#: Vectors that the quantisers are fitted on, at most about.
SAMPLE = 1 << 15
#: Classes of a list, and most lists.
LIST_SIZE, MOST_LISTS = 512, 4096
SUBSPACES, CODES, ROUNDS = 8, 256, 8
#: A list of n classes has about sqrt(n / SPREAD) blocks.
SPREAD = 128
#: Distances that a task holds at once.
CELLS = 1 << 20
#: Against rounding where bounds are compared: only lets more pairs through to the exact cosine.
SLACK = 1e-6


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] + (to * to).sum(1)[None] - 2 * x @ to.T, 0)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    to = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_nearest(x[i : i + 4096], to).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(to))
        sums = np.stack([np.bincount(own, x[:, j], len(to)) for j in range(x.shape[1])], 1)
        to[n > 0] = sums[n > 0] / n[n > 0, None]
    return to


class Quantisers:
    """Coarse centroids and one codebook per subspace; shorter vectors are padded with zeros."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = -(-sample.shape[1] // SUBSPACES)
        self.dims = self.width * SUBSPACES
        x = np.pad(sample, ((0, 0), (0, self.dims - sample.shape[1])))
        self.coarse = np.unique(_kmeans(x, lists, 0), axis=0)  # two equal centroids have no plane between
        left = x - self.coarse[_nearest(x, self.coarse).argmin(1)]
        self.books = [_kmeans(left[:, j * self.width : (j + 1) * self.width], CODES, j + 1) for j in range(SUBSPACES)]

    def assign(self, x: np.ndarray, radius: float):
        """Of unit vectors: list, code, length that the code leaves, and the lists to probe."""
        d = _nearest(x, self.coarse)
        own = d.argmin(1)
        left, codes = x - self.coarse[own], np.empty((len(x), SUBSPACES), np.uint8)
        for j, book in enumerate(self.books):
            part = left[:, j * self.width : (j + 1) * self.width]
            codes[:, j] = _nearest(part, book).argmin(1)
            left[:, j * self.width : (j + 1) * self.width] = part - book[codes[:, j]]
        away = d - d[np.arange(len(x)), own][:, None]
        near = away <= 2 * np.sqrt(_nearest(self.coarse[own], self.coarse)) * (radius / 2 + SLACK)
        near[np.arange(len(x)), own] = False
        return own, codes, np.sqrt((left * left).sum(1)), [np.flatnonzero(r) for r in near]

    def tables(self, x: np.ndarray, home: int) -> list[np.ndarray]:
        """Squared distances of vectors to each subspace's centroids of list `home`."""
        left = x - self.coarse[home]
        return [_nearest(left[:, j * self.width : (j + 1) * self.width], book) for j, book in enumerate(self.books)]


def _unit(arr, dims: int) -> np.ndarray:
    """Rows of a list column as unit vectors of `dims` components, in doubles."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    offs = arr.offsets.to_numpy()
    flat = arr.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.float64)
    n = np.diff(offs)
    x = np.zeros((len(arr), dims))
    x[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], n)] = flat
    x /= np.abs(x).max(1, keepdims=True)  # squares of the largest doubles overflow, of the smallest vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _List:
    """The members of one block of a list, while probes stream past."""

    def __init__(self, key: tuple, cosine: float, quantisers: Quantisers):
        self.home, self.cosine, self.q = key[2], cosine, quantisers
        self.reach = np.sqrt(max(2 - 2 * cosine, 0)) + SLACK
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, *columns) -> None:
        self.parts.append(columns)

    def close(self) -> None:
        """No more members: pairs among them."""
        cols = list(zip(*self.parts))
        self.k, self.n, self.x, self.codes, self.left = (np.concatenate(c) for c in cols[:5])
        self.probes = [p for c in cols[5] for p in c]
        self.links, self.group = np.zeros(len(self.k), np.int64), np.arange(len(self.k))
        self.edges: list[tuple[int, int]] = []
        self.ready = True
        step = max(1, CELLS // max(len(self.k), 1))
        for i in range(0, len(self.k), step):
            rows = np.arange(i, min(i + step, len(self.k)))
            a, b = self.near(self.x[rows])
            a = rows[a]
            later = b > a
            self.count(a[later], b[later])

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of x, member) of the cosine asked for."""
        tables = self.q.tables(x, self.home)
        d = tables[0][:, self.codes[:, 0]]
        for j in range(1, SUBSPACES):
            d += tables[j][:, self.codes[:, j]]
        a, b = np.nonzero(d <= (self.reach + self.left[None]) ** 2)
        if len(a) * 16 > d.size:
            cosine = (x @ self.x.T)[a, b]
        else:
            cosine = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], self.x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        keep = cosine >= self.cosine
        return a[keep], b[keep]

    def count(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links among members."""
        np.add.at(self.links, a, self.n[b])
        np.add.at(self.links, b, self.n[a])
        for row, at in _runs(a):
            self.join(np.append(b[at], row))

    def join(self, members: np.ndarray) -> int:
        """Puts members into one group, with an edge for each group that comes to the first; a member of it."""
        groups = np.unique(self.group[members])
        for g in groups[1:]:
            self.group[self.group == g] = groups[0]
            self.edges.append((int(self.k[groups[0]]), int(self.k[g])))
        return int(groups[0])

    def meet(self, k: np.ndarray, n: np.ndarray, x: np.ndarray, origin: np.ndarray):
        """Probes: yields (probe, links) and keeps the members' links and edges."""
        step = max(1, CELLS // max(len(self.k), 1))
        for i in range(0, len(k), step):
            a, b = self.near(x[i : i + step])
            a += i
            # A pair that both sides' probes find counts in the list of the higher number.
            for o in np.unique(origin[a]):
                if o > self.home:
                    both = np.array([o in p for p in self.probes])
                    keep = (origin[a] != o) | ~both[b]
                    a, b = a[keep], b[keep]
            got = np.zeros(len(k), np.int64)
            np.add.at(got, a, self.n[b])
            np.add.at(self.links, b, n[a])
            for row, at in _runs(a):
                self.edges.append((int(self.k[self.join(b[at])]), int(k[row])))
            hit = np.flatnonzero(got)
            yield k[hit], got[hit]

    def result(self) -> list[tuple]:
        """Links and edges since the last call."""
        hit = np.flatnonzero(self.links)
        out = [*((int(k), None, int(n)) for k, n in zip(self.k[hit], self.links[hit])), *((a, b, 0) for a, b in self.edges)]
        self.links[:], self.edges = 0, []
        return out


def _runs(a: np.ndarray):
    """Rows of a sorted array and where they stand."""
    rows, first, n = np.unique(a, return_index=True, return_counts=True)
    for row, i, m in zip(rows, first, n):
        yield row, slice(i, i + m)


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The table's rows with hashes of vectors that may link (null: that don't), and the staged classes: k, label, size, h1, h2, first_id,
    n, embedding."""
    v = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("embedding"))
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    sound = F.coalesce(sound, F.lit(False))
    hashes = [F.when(sound, F.xxhash64(F.lit(seed), x)).alias(f"h{seed}") for seed in (1, 2)]
    rows = v.select("id", "label", F.size(x).alias("size"), *hashes)
    counted = v.filter(sound).select("id", "label", F.size(x).alias("size"), *hashes, "embedding").groupBy("label", "size", "h1", "h2")
    counted = counted.agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    return rows, staged(counted.withColumn("k", F.monotonically_increasing_id()), "classes")


def _flow(classes: DataFrame, quantisers: Quantisers, cosine: float) -> DataFrame:
    """Staged members: the classes' columns and home, code, left, probes."""
    keep = ["k", "label", "size", "n", "embedding"]
    given = classes.select(*keep)
    out = T.StructType([*given.schema.fields]).add("home", T.IntegerType()).add("code", T.BinaryType()).add("left", T.DoubleType()).add("probes", T.ArrayType(T.IntegerType()))
    radius = float(np.sqrt(max(2 - 2 * cosine, 0)))
    sent = classes.sparkSession.sparkContext.broadcast(quantisers)  # MOST_LISTS + 256 centroids at most

    def run(batches):
        q = sent.value
        step = max(1, CELLS // len(q.coarse))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                own, codes, left, near = q.assign(_unit(b.column("embedding"), q.dims), radius)
                offs = np.concatenate([[0], np.cumsum([len(p) for p in near])]).astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(near).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes]), pa.array(left), probes], names=out.fieldNames())

    return staged(given.mapInArrow(frugal(run), out), "members")


def _meetings(members: DataFrame, quantisers: Quantisers, cosine: float) -> DataFrame:
    """Staged a, b, n: links of class a (b null), or an edge between two classes (n 0)."""
    spark = members.sparkSession
    lists = ["label", "size", "home"]
    blocks = members.groupBy(*lists).agg(F.greatest(F.lit(1), F.round(F.sqrt(F.count("*") / SPREAD))).cast("int").alias("blocks"))
    hot = blocks.filter("blocks > 1")
    own = F.pmod(F.xxhash64("k"), F.coalesce("blocks", F.lit(1))).cast("int")
    nothing = F.lit(None)
    member = members.join(hot, lists, "left").withColumn("block", own)
    base = ["label", "size", "home", "block", "role", "origin", "k", "n", "embedding", "code", "left", "probes"]
    # A member meets its own block as a member, and the later blocks of its list as a probe.
    as_member = member.withColumn("role", F.lit(0)).withColumn("origin", F.col("home")).select(*base)
    later = F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))
    hollow = {"code": nothing.cast("binary"), "left": nothing.cast("double"), "probes": nothing.cast("array<int>")}
    as_probe = member.filter("block + 1 < blocks").withColumn("block", later).withColumn("role", F.lit(1)).withColumn("origin", F.col("home")).withColumns(hollow).select(*base)
    abroad = members.select("label", "size", F.explode("probes").alias("home"), F.col("home").alias("origin"), "k", "n", "embedding")
    abroad = abroad.join(hot, lists, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    abroad = abroad.withColumn("role", F.lit(1)).withColumns(hollow).select(*base)
    key = ["label", "size", "home", "block"]
    flow = as_member.union(as_probe).union(abroad).repartition(partitions(spark), *key).sortWithinPartitions(*key, "role")
    out = T.StructType.fromDDL("a long, b long, n long")
    sent = spark.sparkContext.broadcast(quantisers)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    def run(batches):
        q, held, at = sent.value, None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            roles = batch.column("role").to_numpy()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or roles[i] != roles[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                b = batch.slice(i, j - i)
                if keys[i] != at:
                    if held:
                        if not held.ready:
                            held.close()
                        yield rows(held.result())
                    at, held = keys[i], None
                k, n, x = b.column("k").to_numpy(), b.column("n").to_numpy(), _unit(b.column("embedding"), q.dims)
                if roles[i] == 0:
                    held = held or _List(at, cosine, q)
                    codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
                    held.add(k, n, x, codes, b.column("left").to_numpy(), b.column("probes").to_pylist())
                elif held:  # probes of a list without members meet nothing
                    if not held.ready:
                        held.close()
                    for hit, got in held.meet(k, n, x, b.column("origin").to_numpy()):
                        yield rows([(int(c), None, int(m)) for c, m in zip(hit, got)])
                    yield rows(held.result())
        if held:
            if not held.ready:
                held.close()
            yield rows(held.result())

    return staged(flow.mapInArrow(frugal(run), out), "meetings")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id, kept: one row per vector."""
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    names = (F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    total = classes.count()
    if not total:
        drop(classes)
        return rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("id")).select(*names)
    share = F.pmod(F.xxhash64("h2", "k"), F.lit(1 << 30)) < min(1 << 30, -(-SAMPLE * (1 << 30) // total))
    taken = classes.filter(share).select("embedding").limit(2 * SAMPLE).toArrow().column(0).combine_chunks()
    longest = classes.agg(F.max("size")).first()[0]
    lists = min(MOST_LISTS, max(1, total // LIST_SIZE))
    quantisers = Quantisers(_unit(taken, longest) if len(taken) else np.zeros((1, longest)), lists)
    members = _flow(classes, quantisers, cosine)
    met = _meetings(members, quantisers, cosine)
    links = met.filter("n > 0").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("others"))
    joined = components(met.filter("b is not null").select("a", "b"))
    heads = classes.select("k", "first_id")
    least = joined.join(heads, joined["node"] == heads["k"]).groupBy("component").agg(F.min("first_id").alias("least"))
    named = joined.join(least, "component").select(F.col("node").alias("k"), "least")
    every = classes.select("k", "label", "size", "h1", "h2", "n", "first_id").join(links, "k", "left").join(named, "k", "left")
    every = every.select("label", "size", "h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "first_id").alias("component_id"))
    every = staged(every, "linked")
    drop(classes, members, met)
    out = rows.join(every, ["label", "size", "h1", "h2"], "left")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).withColumn("component_id", F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(*names)
