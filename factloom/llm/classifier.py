"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

One map over the texts computes statistics of each document (shape of words, lines and symbols;
no labels, languages, sources or ids). Random Fourier features approximate a Gaussian kernel over
the standardised statistics; every task sums its share of the normal equations, the sums are added
up row by row of the matrix, and the driver solves a system whose size is the number of features.
A pool-adjacent-violators fit over a fixed grid of raw scores turns them into probabilities.

Defined cases: null is empty text and is scored like any other; repeated label rows of a document
count once (the highest label); labels other than 0 and 1 and labels of unknown documents are not
used; without any usable label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Hasher, flat, frugal, slices, spans
from .staging import drop, partitions, staged

FEATURES = 256
RIDGE = 1.0
BINS = 1000
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1  # lower case
_CLASS[65:91] = 2  # upper case
_CLASS[48:58] = 3  # digits
_CLASS[[0x2C, 0x2E, 0x3B, 0x3A, 0x27, 0x22, 0x28, 0x29, 0x2D]] = 4  # punctuation
_CLASS[[0x21, 0x3F]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\/=+_~^@`"]] = 6  # symbols
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 7
_CLASS[0x0A] = 8
_CLASS[128:] = 9
N_STATS = 26


def _per(mask_sum: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask_sum)])
    return c[at[1:]] - c[at[:-1]]


def _distinct(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and uses of its most frequent key."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    uses = np.diff(np.append(first, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[first], uses)
    return np.bincount(d[first], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of each text, as rows of N_STATS numbers."""
    data, offs = flat(texts)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(doc * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    size = np.maximum(np.diff(offs), 1).astype(float)[:, None]
    starts, ends, at = spans(data, offs)
    words = np.diff(at).astype(float)
    w = np.maximum(words, 1)
    hasher = Hasher(data)
    keys = hasher(starts, ends)
    lens = (ends - starts).astype(float)
    mean = _per(lens, at) / w
    spread = np.sqrt(np.maximum(_per(lens * lens, at) / w - mean**2, 0))
    kinds_of_words, most = _distinct(keys, at)
    same_doc = np.repeat(np.arange(n), np.diff(at))
    beside = np.append(False, (keys[1:] == keys[:-1]) & (same_doc[1:] == same_doc[:-1])) if len(keys) else np.zeros(0, bool)
    pair = keys.copy()
    pair[1:] = keys[1:] * np.uint64(3) + keys[:-1]
    pairs, _ = _distinct(pair, at)
    caps = (_CLASS[data[starts]] == 2) if len(starts) else np.zeros(0, bool)
    shout = caps & (lens > 1) & (_CLASS[data[ends - 1 - (_CLASS[data[ends - 1]] != 2) * (lens > 2)]] == 2) if len(starts) else caps
    closed = np.isin(data[ends - 1], [0x2E, 0x21, 0x3F]) if len(ends) else caps
    lone = lens == 1
    newline = data == 0x0A
    line_starts = np.append(True, newline[:-1]) if len(data) else np.zeros(0, bool)
    line_starts[offs[:-1][offs[:-1] < len(data)]] = True
    ls = np.flatnonzero(line_starts)
    le = np.append(ls[1:], len(data))
    line_at = np.searchsorted(ls, offs)
    lines = np.maximum(np.diff(line_at), 1).astype(float)
    kinds_of_lines, _ = _distinct(hasher(ls, le), line_at)
    in_line = _per((np.searchsorted(starts, le) - np.searchsorted(starts, ls) <= 2).astype(float), line_at)
    out = np.column_stack([
        np.log1p(words), mean, spread, kinds_of_words / w, np.log1p(w) * kinds_of_words / w, most / w, _per(beside.astype(float), at) / w, pairs / w,
        _per(caps.astype(float), at) / w, _per(shout.astype(float), at) / w, _per(closed.astype(float), at) / w, _per(lone.astype(float), at) / w,
        np.log1p(lines), kinds_of_lines / lines, np.log1p(words / lines), in_line / lines, kinds / size,
    ])
    return out.astype(np.float32)


def features_of(docs: DataFrame) -> DataFrame:
    out = T.StructType().add(docs.schema["doc_id"]).add("stats", T.ArrayType(T.FloatType()))

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                x = statistics(b.column("text"))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], names=out.fieldNames())

    return docs.mapInArrow(frugal(run), out)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), N_STATS)


class Fourier:
    """Standardises statistics and maps them to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / math.sqrt(N_STATS), (N_STATS, features))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        f = np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.column_stack([f, np.ones(len(x))])


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators means of bins with sums y over n rows; empty bins take their neighbours'."""
    blocks: list[list[float]] = []
    for s, c in zip(y.tolist(), n.tolist()):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]):
            s2, c2, k2 = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += c2
            blocks[-1][2] += k2
    return np.concatenate([np.full(int(k), s / c if c else 0.5) for s, c, k in blocks])


class Model:
    """A fitted classifier: statistics to scores."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, curve: np.ndarray | None):
        self.fourier, self.weights, self.curve = fourier, weights, curve

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        raw = self.fourier(x) @ self.weights
        # A small share of the raw score keeps the order within the flat steps of the curve.
        return np.clip(0.99 * self.curve[bins(raw)] + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)

    def column(self, text) -> Column:
        """Score of a text column, as an expression."""
        model = self

        @F.arrow_udf(T.DoubleType())
        def scored(texts: pa.Array) -> pa.Array:
            parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
            return pa.array(np.concatenate([np.zeros(0), *(model(statistics(b.column("text"))) for b in parts)]), pa.float64())

        return scored(text)


def fit(stats: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES) -> Model:
    """Fits on the rows of stats (doc_id, stats) whose label learn_from lets it see."""
    spark = stats.sparkSession
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0)).filter(learn_from)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = staged(stats.join(known, "doc_id").select("stats", "label"), "labelled")
    sums = rows.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    if not sums:
        drop(rows)
        return Model(None, None, None)
    moments = sorted((r["k"], r["m"], r["s"]) for r in sums)
    fourier = Fourier(np.array([m for _, m, _ in moments]), np.array([s for *_, s in moments]), features)
    pair = T.StructType().add("k", T.IntegerType()).add("v", T.BinaryType())

    def equations(batches):
        total = np.zeros((features + 2, features + 1))
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                z, y = fourier(_matrix(part.column("stats"))), np.asarray(part.column("label"), float)
                total[:-1] += z.T @ z
                total[-1] += y @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["k", "v"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(v)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], names=["k", "v"])

    solved = {r["k"]: np.frombuffer(r["v"]) for r in rows.mapInArrow(frugal(equations), pair).repartition(min(16, partitions(spark)), "k").mapInArrow(frugal(added), pair).collect()}
    a = np.array([solved[k] for k in range(features + 1)])
    weights = np.linalg.solve(a + RIDGE * np.eye(len(a)), solved[features + 1])
    binned = T.StructType().add("bin", T.IntegerType()).add("y", T.DoubleType()).add("n", T.LongType())

    def histogram(batches):
        y, n = np.zeros(BINS), np.zeros(BINS, np.int64)
        for b in batches:
            at = bins(fourier(_matrix(b.column("stats"))) @ weights)
            np.add.at(y, at, np.asarray(b.column("label"), float))
            np.add.at(n, at, 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(y[used]), pa.array(n[used])], names=binned.fieldNames())

    y, n = np.zeros(BINS), np.zeros(BINS)
    for r in rows.mapInArrow(frugal(histogram), binned).groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect():
        y[r["bin"]], n[r["bin"]] = r["y"], r["n"]
    drop(rows)
    return Model(fourier, weights, isotonic(y, n))


def score(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = FEATURES) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier). learn_from: condition on doc_id for rows whose
    labels may be learned from; labels of other rows are never read into the fit."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    stats = staged(features_of(src), "stats")
    model = fit(stats, labels, learn_from, id_col, label_col, features)
    out = T.StructType().add(stats.schema["doc_id"]).add("score", T.DoubleType())

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model(_matrix(b.column("stats"))))], names=out.fieldNames())

    return stats.mapInArrow(frugal(scored), out)


def keep_good(docs: DataFrame, labels: DataFrame, learn_from, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that score at least threshold. The fit reads the texts once, the filter once more."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    stats = staged(features_of(src), "stats")
    model = fit(stats, labels, learn_from, id_col, label_col)
    drop(stats)
    return docs.filter(model.column(docs[text_col].cast("string")) >= threshold)


def bins(raw: np.ndarray) -> np.ndarray:
    """Bin of a raw score, on a fixed grid over -0.5 to 1.5."""
    return np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int64)


def held_out(doc_id: str = "doc_id"):
    """Remainder 0 of crc32(doc_id as text) by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
