"""Conversation repair, embedding near-duplicates and importance resampling against brute force, on hostile rows."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import queries, repair, resampling, vector_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


# -- conversation repair ------------------------------------------------------------------------------------------
def plain_repair(rows):
    """The least (cost, audit) over all edits, whole audits compared, with what it gives: rows of (role, text, fault)."""

    @functools.lru_cache(maxsize=None)
    def best(i, roles, inserts):
        ends = [(0, "", ())] if i == len(rows) and re.fullmatch(GRAMMAR, roles) else []
        ways = [("I", 3, i, (r, "")) for r in ("user", "assistant")] if inserts < 4 else []
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append(("D", 4, i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [("K", more, i + 1, (role, text)), ("R", more + 3, i + 1, ("user", text)), ("R", more + 3, i + 1, ("assistant", text))]
        for edit, cost, to, out in ways:
            after = roles + out[0][:1] if out else roles
            if out and (not out[0] or not any(re.fullmatch(GRAMMAR, after + tail) for tail in ("", "a", "ua"))):
                continue
            rest = best(to, after, inserts + 1 if edit == "I" else 0)
            if rest:
                ends.append((cost + rest[0], edit + rest[1], (() if out is None else (out,)) + rest[2]))
        return min(ends, key=lambda e: e[:2], default=None)

    return best(0, "", 0)


def plain_conversations(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * ((kind != 0) + (kind == 3))
    for conv, rows in kept.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, out = plain_repair([(r, x, f) for (_, r, x), f in zip(rows, faults)])
        n = Counter(faults)
        yield conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def hostile_conversations():
    r = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "ufo", "Assistant"]
    texts = ["Yes.", "No!", "why", "", None, " \n\t", "so it ends?  \n", "é…", "x. y", "\x0b.", "Yes."]
    rows = []
    for conv in range(120):
        for _ in range(r.randrange(1, 9)):
            rows.append((conv, r.choice([None, *range(7), 40]), r.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1])[0], r.choice(texts)))
    return rows + [(None, 0, "user", "no id."), (None, None, None, None), (-3, 2, "system", "s.")]


def test_repair(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()] + hostile_conversations()
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("x")).withColumn("gone", F.lit(None).cast("int"))
    got = repair.digests(repair.repair(repair.damaged(df)))
    assert Counter(map(tuple, got.collect())) == Counter(plain_conversations(rows))
    assert repair.digests(repair.repair(repair.damaged(df.limit(0)))).count() == 0


def test_repaired_rows_and_long_conversation(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "broken off"), (2, 0, "user", " ")]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("conv_id", "seq").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in out] == [(1, "K", "system", "s."), (1, "R", "user", "a."), (1, "K", "assistant", "broken off"), (2, "D", None, None)]
    n = 30_000
    long = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('turn ', id, '.') as text")
    r = repair.digests(repair.repair(long)).first()
    # u a a: the second assistant goes (4) or gets a user before it (3).
    assert r["audit"] == "KKIK" * (n // 3) and r["cost"] == n and r["illegal"] == n // 3


def test_shortest_path_equals_enumeration():
    r = random.Random(11)
    for _ in range(300):
        rows = [(r.choice(["s", "u", "a", "x", ""]), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(7))]
        names = [None, "blank", "duplicate", "truncated"]
        cost, audit, _ = plain_repair([(a, "t", names[f]) for a, f in rows])
        assert repair.shortest(rows) == (cost, audit)


# -- embedding near-duplicates ------------------------------------------------------------------------------------
def plain_links(rows, cosine):
    sound = {}
    for i, (_, x, label) in enumerate(rows):
        if label is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            v = np.array(x, float)
            v /= np.abs(v).max()
            sound[i] = v / np.linalg.norm(v)
    links = defaultdict(set)
    for i in sound:
        for j in sound:
            if i != j and rows[i][2] == rows[j][2] and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= cosine:
                links[i].add(j)
    for i in range(len(rows)):
        todo, reached = [i], {i}
        while todo:
            for j in links[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        least = min(ids) if ids else None
        yield rows[i][0], len(links[i]), least, rows[i][0] == least


def hostile_vectors(kind="float"):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=10)
            for _ in range(rng.integers(1, 9)):  # chains of neighbours around each centre
                centre = centre + rng.normal(size=10) * 0.13
                rows.append((i, [float(np.float32(c)) for c in centre], label))
                i += 1
    x = rows[0][1]
    rows += [(i, x, 0), (i + 1, x, 1), (i + 2, [c * 3 for c in x], 0), (i + 3, None, 0), (i + 4, [], 0), (i + 5, [0.0] * 10, 0), (i + 6, [*x[:9], math.nan], 0), (i + 7, [*x[:9], math.inf], 0), (i + 8, [*x[:9], None], 0)]
    rows += [(i + 9, x[:9], 0), (i + 10, [-c for c in x], 0), (None, x, 0), (None, x, 0), (i, x, 0), (None, [1e30] + [0.0] * 9, 5), (None, [1e30] + [0.0] * 9, 5)]
    hot = rng.normal(size=10)
    rows += [(2000 + j, [float(np.float32(c)) for c in hot + rng.normal(size=10) * 0.03], 1) for j in range(250)]
    return rows


@pytest.mark.parametrize("size", [512, 20])
def test_vectors(spark, size, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LIST_SIZE", size)
    monkeypatch.setattr(vector_dedup, "SPREAD", size / 16)
    monkeypatch.setattr(vector_dedup, "CELLS", 2048)
    rows = hostile_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as k", "'x' as size", "2 as n").repartition(3)
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], y) for i, x, y in rows]
    got = Counter(tuple(r) for r in vector_dedup.near_duplicates(df).collect())
    assert got == Counter(plain_links(rows, 0.98))
    assert max(n for _, n, *_ in got) > 200 and sum(1 for _, n, *_ in got if n) > 300
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
    assert vector_dedup.near_duplicates(df.filter("embedding is null")).first()["kept"]


def test_probes_are_sufficient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = vector_dedup.Quantisers(x[:1000], 40)
    y = x + rng.normal(size=x.shape) * 0.2 / math.sqrt(24) * rng.random((3000, 1))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = np.linalg.norm(x - y, axis=1) <= 0.2
    a, _, _, pa = q.assign(x, 0.2)
    b, codes, left, pb = q.assign(y, 0.2)
    for i in np.flatnonzero(near):
        assert a[i] == b[i] or b[i] in pa[i] or a[i] in pb[i]
    for i in np.flatnonzero(near)[:300]:  # asymmetric distances don't exceed the radius by more than the code leaves
        d = sum(t[0, c] for t, c in zip(q.tables(x[i : i + 1], b[i]), codes[i]))
        assert math.sqrt(d) <= 0.2 + left[i] + 1e-9


# -- importance resampling ----------------------------------------------------------------------------------------
def plain_resample(docs, target, most, buckets=10_000, percent=10, min_words=20):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, feats(x)[1]))
    for x in target:
        t.update(map(bucket, feats(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for k, (i, x) in enumerate(docs):
        words, f = feats(x)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("most,chunk", [(1, 4 << 20), (1, 2000), (3, 20_000)])
def test_resampling(spark, most, chunk, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", chunk)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(900001, None), (900002, ""), (900003, "ÉCOLE école İx ΣΑΣ—word  A-b_c 1e5"), (900004, "the " * 30_000), (None, "le la " * 30), (900005, docs[0][1]), (900005, docs[0][1]), (900006, "-- \x00\n")]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as gain", "'x' as feature", "2 as row").repartition(3)
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resampling.resample(df, aim, most=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resample(docs, target, most)
    assert resampling.resample(df.limit(0), aim).count() == 0
    assert resampling.resample(df, aim.limit(0), min_words=0, percent=100).filter("rank is null").count() == 0


def test_queries_give_the_contracts_columns(spark):
    want = {
        "op11_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"], "op12_vector_dedup": ["vec_id", "n_links", "component_id", "kept"],
        "op13_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
    }
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, SF).columns == cols
