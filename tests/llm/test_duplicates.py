"""Jaccard join, components and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import components, jaccard_join, suffix_dedup  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_texts(seed=3):
    """Groups of near copies around a base, chains, copies, short and empty texts, shared passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    texts = []
    passage = " ".join(word() for _ in range(40))
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(40, 120))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(20):
        texts.append(" ".join(word() for _ in range(30)) + "\n" + passage + " " + word())
    texts += [texts[0], texts[0].upper().replace("É", "é"), "", None, " \n", "one", "one two", "ONE", "one two", "ab " * 200, "ab " * 230, "x" * 100, "x" * 99, "x" * 350, "é" * 80]
    rnd.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 1000, t, "n") for k, t in enumerate(made_texts())]
    rows += [(rows[5][0], rows[5][1], "n"), (rows[6][0], "another text under the same id " * 9, "n"), (None, rows[7][1], "n"), (None, rows[7][1], "n")]
    rows += [(None, rows[8][1] + " and more", "n"), (None, rows[9][1] + " and more", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, size string").withColumn("node", F.lit(1)).repartition(3).cache()


def brute_components(rows, n, num, den):
    def grams(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(t)
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if None not in (rows[i][0], rows[j][0]) and a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), d if d is None or not s else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components(docs, n, num, den):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs, n=n, num=num, den=den).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, n, num, den))


def test_jaccard_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs, n=3, num=90, den=100).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, 3, 90, 100))


def test_jaccard_empty_and_keep_one(spark, docs):
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    verdict = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    want = {d for d, c in verdict if d is not None and d == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 4


def test_one_common_ngram_in_unlike_texts(spark, monkeypatch):
    """Texts that share one n-gram before all others aren't compared with each other; near copies among them are found."""
    rnd = random.Random(5)
    lines, often = [], [f"w{k}" for k in range(40_000)]
    for k in range(1500):
        words = ["shared"] + rnd.sample(often, 40)
        lines.append(" ".join(words))
        if k % 10 == 0:
            lines.append(" ".join([*words[:-1], "other"]))
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    real = jaccard_join.gram_counts
    first = int(jaccard_join.shingles(__import__("pyarrow").array(["shared"]), 1)[0][0] % np.uint64(jaccard_join.SLOTS))

    def counts(*args):  # as if it were the rarest
        out = real(*args)
        out[first] = 0
        return out

    monkeypatch.setattr(jaccard_join, "gram_counts", counts)
    made = []
    monkeypatch.setattr(jaccard_join, "_pairs", lambda p, f=jaccard_join._pairs: (made.append(p.count()), f(p))[1])
    got = jaccard_join.jaccard_components(docs, n=1, num=9, den=10).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, 1, 9, 10))
    assert sum(made) < 20 * len(rows)


def test_sets_of_one_hash(spark, docs, monkeypatch):
    real = jaccard_join._nodes
    monkeypatch.setattr(jaccard_join, "_nodes", lambda g, at: (real(g, at)[0] % 7, real(g, at)[1]))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs, n=3, num=90, den=100).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, 3, 90, 100))


def test_keep_one_with_clashing_names(spark, docs):
    named = docs.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(("_kept", "_nth", "rows", "row", "id", "component_id", "n_shingles"))))
    got, want = jaccard_join.keep_one(named), jaccard_join.keep_one(docs)
    assert got.columns == named.columns and Counter(map(tuple, got.select("doc_id", "text").collect())) == Counter(map(tuple, want.select("doc_id", "text").collect()))


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def brute_dedup(rows, length):
    """rows in their order of judgement: (doc_id, bytes, again)."""
    seen, out = set(), []
    for d, raw, again in rows:
        n = len(raw)
        gone = np.zeros(n, bool)
        if again:
            gone[:] = n >= length
        else:
            for i in range(n - length + 1):
                w = raw[i : i + length]
                if w in seen:
                    gone[i : i + length] = True
                else:
                    seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, n, int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def in_order(docs):
    t = F.coalesce("text", F.lit(""))
    nameless = F.xxhash64(t, F.lit(1)).bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select("doc_id", t.alias("t"), F.shiftright(F.xxhash64(t), 32).cast("int").alias("tie"), F.coalesce("doc_id", nameless).alias("at")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["at"], r["tie"]))
    seen = set()
    out = []
    for r in rows:
        key = (r["doc_id"], r["tie"])
        out.append((r["doc_id"], r["t"].encode(), key in seen))
        seen.add(key)
    return out


@pytest.mark.parametrize("bucket_records", [1 << 20, 64])
def test_suffix_dedup(docs, monkeypatch, bucket_records):
    monkeypatch.setattr(suffix_dedup, "BUCKET_RECORDS", bucket_records)
    got = suffix_dedup.dedup_substrings(docs).drop("kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_dedup(in_order(docs), 100))
    got = suffix_dedup.dedup_substrings(docs, length=70, gram=21).drop("kept").collect()  # a lead of two words and a part
    assert Counter(map(tuple, got)) == Counter(brute_dedup(in_order(docs), 70))
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_suffix_dedup_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = suffix_dedup.dedup_substrings(docs, carry=("lang", "source")).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(brute_dedup(in_order(docs), 100))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and r["carried"]["lang"] for r in got)


def test_suffix_dedup_of_a_long_text_and_one_gram(spark):
    """A text of many windows and a passage in all documents: runs that several buckets share."""
    rnd = random.Random(8)
    passage = "the same passage stands in each of them and goes on for more than one hundred and ten bytes, so it is found as repeated "
    rows = [(k, "".join(rnd.choice("abcdefgh ") for _ in range(60)) + passage) for k in range(300)] + [(1000, " ".join(str(rnd.randrange(10**6)) for _ in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup_substrings(docs).drop("kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_dedup(in_order(docs), 100))


def test_lead_sorts_like_bytes():
    rnd = random.Random(1)
    raw = [bytes(rnd.choice(b"\x00\x7f\x80\xffab") for _ in range(24)) for _ in range(200)]
    words = suffix_dedup._lead(np.frombuffer(b"".join(raw), np.uint8), np.arange(200) * 24, 24)
    order = suffix_dedup.multikey_quicksort(words)
    assert [raw[i] for i in order] == sorted(raw)


def test_multikey_quicksort_and_sliding_min():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    order = suffix_dedup.multikey_quicksort(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))
    x = rng.integers(0, 50, 200).astype(np.uint64)
    assert list(suffix_dedup.sliding_min(x, 7)) == [min(x[i : i + 7]) for i in range(194)]
    cuts = np.unique(np.stack([k[:9] for k in keys], axis=1), axis=0)
    assert list(suffix_dedup.buckets(keys, cuts)) == [sum(tuple(s) < t for s in map(tuple, cuts)) for t in zip(*keys)]
