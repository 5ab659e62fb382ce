"""Operators against brute force, on a small table and on hostile rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P

pytest.importorskip("factloom.llm")
from factloom.llm import byte_bpe, chat, classifier, fingerprints, packing, pii, quality_rules, queries, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    (900001, None, "en", "s"), (900002, "", "en", "s"), (900003, " \n\t ", None, None), (900004, "é" * 5000 + " x" * 4000, "fr", "s"), (900005, "same text here twice\n" * 30, "en", "s"),
    (900005, "same text here twice\n" * 30, "en", "s"), (None, "a row without an id, 10.0.0.1", "en", None), (900006, "It's  we'll\n\n  THE END.. don’t<|endoftext|>  　x", "en", "s"), (900007, "abc,def.ghi İstanbul ΣΑΣ", "en", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD, base.schema)
    from pyspark.sql import functions as F

    return base.union(odd).withColumn("ids", F.lit(1)).withColumn("start", F.lit("x")).withColumn("n_words", F.lit(None).cast("int")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_byte_bpe(docs, rows):
    ranks = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoder(ranks, P.PATTERN)
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    encoded = byte_bpe.encode(docs, ranks, P.PATTERN)
    same(byte_bpe.digests(encoded, ranks).collect(), want)
    same([(r["doc_id"], bytes(r["text_bytes"])) for r in byte_bpe.decode(encoded, ranks).collect()], [(i, t.encode()) for i, t, _ in rows])
    assert byte_bpe.encode(docs.limit(0), ranks, P.PATTERN).count() == 0


def test_packing(docs, rows):
    path = P.path("word_bpe_49k.json")
    tok = packing.tokenizer(path)
    want = Counter()
    for i, t, _ in rows:
        want[i, tuple(tok.encode(t, add_special_tokens=False).ids + [1])] += 1
    got = packing.pack(docs.repartition(2), path).collect()
    seqs, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(r["ids"])))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    for (i, ids), n in want.items():
        pieces = by_doc[i, len(ids)]
        starts = sorted({s for s, _ in pieces})
        for s, piece in pieces:
            assert ids[s : s + len(piece)] == piece or n == 0 or any(k[0] == i and k[1][s : s + len(piece)] == piece for k in want)
        assert starts[0] == 0
    assert sum(r["length"] for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "A<|endoftext|>b.C", "<|ENDOFTEXT|> x", "Ab <|EndOfText|>,a", "'<|startoftext|>'S<|endoftext|><|endoftext|>É", "<|endof", "text|>", "<|ENDOF", "TEXT|>.a", "<|endof text|>", "plain, Text."]
    path, fresh = P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["ids"] for r in packing.pack(df, path).collect()}
    assert got[0] == [49407, 1] and got == {k: [*fresh.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


def test_best_fit_decreasing_is_what_a_plain_search_finds():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 65, 80)
        where, offset = packing.best_fit_decreasing(lengths, 64)
        room, want = [], np.zeros(80, int)
        for k in np.argsort(-lengths, kind="stable"):
            fits = [c for c in room if c >= lengths[k]]
            if fits:
                room[room.index(min(fits))] -= lengths[k]
            else:
                room.append(64 - lengths[k])
        assert where.max() + 1 == len(room)
        used = np.bincount(where, weights=lengths)
        assert sorted(64 - used) == sorted(room) and (offset + lengths <= 64).all()


def test_chat(spark):
    says = "</s>[INST] ok [/INST]"
    given = [(-7, 0, "user", says), (-7, 1, "assistant", says), (1, 2, "assistant", "b\\<|end|>\\"), (1, 1, "user", None), (1, 3, None, "x"), (1, 3, None, "x"), (2, 1, "assistant", "<|turn|><|text|>é"), (None, 1, "assistant", "n"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    want = []
    for conv in {g[0] for g in given}:
        turns = sorted([(t, r or "", x or "") for c, t, r, x in given if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    formatted = chat.format_turns(df)
    same([tuple(r)[:5] for r in chat.read_back(formatted).collect()], want)
    for r in formatted.collect():
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>") == 1 and "[INST]" not in r["formatted"]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_fingerprints(docs, rows):
    got = fingerprints.edited_likeness(docs, ranges=5).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t, _) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    same([tuple(r)[:3] for r in got], want)
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    for r in got:
        assert alone[r["doc_id"]] == r["fingerprint"] or r["doc_id"] is None
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    full = [r["near_edited"] for r in got if r["n_chars"] > 400]
    assert np.median(full) > 0.4
    assert fingerprints.edited_likeness(docs.limit(0)).count() == 0
    assert fingerprints.edited_likeness(docs.filter("doc_id = 900004")).first()["near_next"] == 1.0


def plain_chunks(text):
    """Chunks of a text by a byte-wise gear hash."""
    raw, h, at, out = text.encode(), 0, 0, []
    for i, c in enumerate(raw):
        h = (h << 1) + int(fingerprints._GEAR[c]) & 0xFFFFFFFF
        size = i - at + 1
        strict, loose = h & int(fingerprints._STRICT) == 0, h & int(fingerprints._LOOSE) == 0
        if size >= fingerprints.LEAST and (strict and size < fingerprints.NORMAL or loose and size >= fingerprints.NORMAL) or size == fingerprints.MOST:
            out.append(raw[at : i + 1])
            at = i + 1
    return [*out, raw[at:]] if raw[at:] else out


def test_fingerprints_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    sets = [set(plain_chunks(t)) for t in texts]

    def likeness(a, b):
        return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)

    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    for k, (i, t) in enumerate(zip(sorted(got), texts)):
        nxt = texts[(k + 1) % len(texts)]
        edited = set(plain_chunks(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]))
        r = got[i]
        assert len(r["fingerprint"]) == 18 * len(sets[k]) and sorted(int(r["fingerprint"][j + 16 : j + 18], 16) for j in range(0, len(r["fingerprint"]), 18)) == sorted(map(len, sets[k]))
        assert r["near_edited"] == pytest.approx(likeness(sets[k], edited)) and r["near_next"] == pytest.approx(likeness(sets[k], sets[(k + 1) % len(texts)]))


def test_gear_chunks_are_those_of_each_text_alone():
    import pyarrow as pa

    texts = ["", "abc", "hello world " * 50, "x" * 1000, "é" * 300]
    assert fingerprints.fingerprints(pa.array(texts)) == [fingerprints.fingerprints(pa.array([t]))[0] for t in texts]


def test_quality_rules(docs, rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    limit = 2

    def normal(x):
        return " ".join(word.findall(re.sub("[0-9]", "0", x.lower())))

    holds = {}
    for i, t, h in rows:
        for x in t.split("\n"):
            if normal(x):
                holds.setdefault((h, normal(x)), set()).add(t)
    want = []
    for i, t, h in rows:
        w = word.findall(t)
        lines = [x for x in t.split("\n") if word.search(x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        gone = sum(len(word.findall(x)) for x in lines if len(holds[h, normal(x)]) > limit)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed, gone, not failed and len(w) - gone >= 50 and 2 * (len(w) - gone) >= len(w)))
    same(quality_rules.quality_rules(docs, max_line_texts=limit).collect(), want)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    cleaned = quality_rules.quality_rules(docs, max_line_texts=limit, with_text=True).collect()
    kept = {r["doc_id"]: r["text"] for r in cleaned}
    for i, t, h in rows:
        if i:
            assert kept[i] == "\n".join(x for x in t.split("\n") if not normal(x) or len(holds[h, normal(x)]) <= limit)


def test_quality_rules_judge_repeated_rows_once(spark):
    """Of 100 words 30 are in a frequent line: kept, however often the row, or its text without an id, is repeated."""
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(70)).translate(str.maketrans("0123456789", "abcdefghij"))
    common = " ".join(["common"] + [chr(97 + j) * 3 for j in range(14)])
    texts = [f"{common}\n{own(k)}\n{common}" for k in range(4)]
    given = [(0, texts[0]), (1, texts[1]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "h") for i, t in given], "doc_id long, text string, source string")
    got = quality_rules.quality_rules(df, max_line_texts=2).collect()
    assert [(r["n_words"], r["n_words_removed"], r["kept"]) for r in got] == [(100, 30, True)] * len(given)


def test_quality_rules_count_copies_as_documents(spark):
    """A line in exact copies under three ids is frequent; in three rows of one id it isn't."""
    given = [(k, "in copies", "h") for k in range(3)] + [(7, "in one document", "h")] * 3
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_words_removed"] for r in quality_rules.quality_rules(df, max_line_texts=2).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 7: 0}


def test_pii(spark):
    texts = [
        "mail Ann.Lee@Example.com or ann.lee@example.com, ip 10.1.2.3, card 4111 1111 1111 1111 and 4111111111111111.", "call +1 (017) 555-7713 or +1-017-555-7713; Mr Smith met Mrs Jones and Mr Smith. Господин Иванов", None, "",
        "nothing here but 12 and 2024", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "call +1 (017) 555-7713",
    ]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, _new string, _found int")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "k").collect()}
    assert got[2] is None and got[3] == "" and got[4] == texts[4] and got[7] == got[0]
    for secret in ("Lee", "10.1.2.3", "4111", "555-7713", "Smith", "Jones", "Иванов", "04dbebab"):
        assert all(secret not in (t or "") for t in got.values())
    a, b = re.findall(r"\S+@\S+\.com", got[0])
    assert a.lower() == b and a[0].isupper()
    spaced, plain = re.search(r"card (.{19}) and (\d{16})", got[0]).groups()
    assert spaced.replace(" ", "") == plain
    digits = [int(c) for c in reversed(plain)]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    first, second = re.findall(r"\+1[ -](?:\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4})", got[1])
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) and first in got[6]
    m = re.findall(r"Mr (\w+)", got[1])
    assert m[0] == m[1] and m[0].endswith("o") and re.search(r"Mrs (\w+)a\b", got[1]) and re.search("Господин [А-я]+ов", got[1])
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_pii_finds_what_stands_alone(spark):
    """Labelled texts of one entity each, without a digit, an at sign or a title elsewhere; and texts without any."""
    rng = np.random.default_rng(9)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hidden = ["AKIA" + letters(upper, 16) for _ in range(20)] + [f"{k}_{letters(upper.lower(), 24)}" for k in ("sk", "pk", "ghp", "gho", "xoxb", "xoxp") for _ in range(5)]
    hidden += [letters("abcdef", 40) for _ in range(10)] + [letters("ABCDEF", 32) for _ in range(10)]
    names = ["Mrs. O'Brien", "Mr de Gaulle", "Dr Who", "Prof. Anna-Maria Müller-Lüdenscheidt", "Herr von der Leyen", "Señora D’Angelo", "Доктор Живаго", "Frau Maria van den Berg"]
    clean = ["The drum in AKI, the risky task_list and abcdef fade; xox pk sk gh.", "Mr and Mrs said no. Drs of Prof nothing de la rue"]
    rows = [f"so says {x} today" for x in [*hidden, *names]] + clean
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[-2:] == clean and all(x not in y for x, y in zip([*hidden, *names], got)) and all(y.startswith("so says ") and y.endswith(" today") for y in got[:-2])
    for name, text in zip(names, got[len(hidden) : -2]):
        words = re.findall(r"[\w'’\-]{3,}", name)[1:]
        assert all(w not in text.split() for w in words if w[0].isupper()) and text.split()[2] == name.split()[0]
    assert "de " in got[len(hidden) + 1] and "von der " in got[len(hidden) + 4]


def test_pii_collisions_are_resolved(spark, monkeypatch):
    """With a surrogate space of a few octets, first attempts collide; final surrogates don't."""
    real = pii._number
    monkeypatch.setattr(pii, "_number", lambda s, i, digits=2: real(s, i, digits) % 3 if digits == 4 else real(s, i, digits))
    texts = [f"host 10.0.0.{k} end" for k in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == 25 and not set(got) & set(texts)


def test_pii_collision_check_writes_few_files(spark, monkeypatch):
    """With many partitions that stay apart, a corpus without collisions writes no table, one with them tables of colliding
    entities alone; nothing stays persisted."""
    names, real, number = [], pii.staged, pii._number
    monkeypatch.setattr(pii, "staged", lambda df, name: names.append(name) or real(df, name))
    texts = [f"host 10.0.{k % 5}.{k // 5} of kate{k:02}@example.org end" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, kept = {k: spark.conf.get(k) for k in conf}, spark.sparkContext._jsc.getPersistentRDDs().size()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
        assert len(set(got)) == 60 and not set(got) & set(texts) and names == []
        monkeypatch.setattr(pii, "_number", lambda s, i, digits=2: number(s, i, digits) % 5 if digits == 4 else number(s, i, digits))
        got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({x.split()[1] for x in got}) == 60 and not {x.split()[1] for x in got} & {x.split()[1] for x in texts}
    assert set(names[:-1]) == {"entities"} and names[-1] == "attempts"
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_pii_surrogates_are_functions_of_the_normal_form(spark):
    """Spellings of one entity have equal normal forms, and so have their surrogates."""
    same_entity = [
        ["+1 555-123-4567", "+15551234567", "+1 (555) 123-4567", "+1-555-123-4567"], ["+49 3012 345 6789", "+4930123456789"], ["+420 601 123 4567", "+4206011234567"],
        ["555-123-4567", "(555) 123-4567"], ["Mrs Smith", "Ms. Smith", "Frau Smith", "Госпожа Smith"], ["Mr Smith", "Herr Smith", "Господин Smith"], ["ΑΒΣ@Example.gr", "αβς@example.gr"], ["4111-1111-1111-1111", "4111111111111111"],
    ]
    df = spark.createDataFrame([(k, f"about {x} end") for k, x in enumerate(x for g in same_entity for x in g)], "doc_id long, text string")
    got = [r["text"][6:-4] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    from pyspark.sql import functions as F

    norm = lambda xs: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, v string").orderBy("i").select(pii.normal(pii.kind_of(F.col("v")), F.col("v"))).collect()]
    given, new = norm([x for g in same_entity for x in g]), norm(got)
    at = 0
    for g in same_entity:
        assert len(set(given[at : at + len(g)])) == 1 and len(set(new[at : at + len(g)])) == 1 and given[at] != new[at]
        at += len(g)
    assert all(x.startswith(c) for x, c in zip(got, ["+1", "+1", "+1", "+1", "+49", "+49", "+420", "+420"]))


def test_pii_surrogates_stay_apart_under_every_title(spark):
    """Of 400 names, all with both titles or with one, no two share a surrogate of either gender."""
    names = sorted({f"{a}{b}{c}" for a in ("Ba", "Ke", "Lo", "Mi", "Nu") for b in ("ra", "ste", "gli", "dro", "pu", "ve", "shi", "no") for c in ("n", "k", "ll", "x", "m", "th", "rd", "s", "ck", "ff")})
    texts = [f"{t} {n}" for k, n in enumerate(names) for t in (("Mr", "Mrs") if k % 2 else ("Mrs",))]
    df = spark.createDataFrame([(k, f"so {x}, ok") for k, x in enumerate(texts)], "doc_id long, text string")
    got = [r["text"][3:-4] for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)


def test_pii_surrogate_space_outgrows_the_entities(spark, monkeypatch):
    """More surnames and addresses than first surrogates: 300 names for one stem, 60 locals for two."""
    real = pii._number
    monkeypatch.setattr(pii, "_number", lambda s, i, digits=2: F.when((F.lit(i) if isinstance(i, int) else i) < 20, real(s, i, digits) * 0).otherwise(real(s, i, digits)))
    monkeypatch.setattr(pii, "MAX_ROUNDS", 12)
    from pyspark.sql import functions as F

    texts = [f"see {t} {a}{b}{c} now" for t in ("Mrs", "Господин") for a in ("Ba", "Ke", "Lo", "Mi", "Nu") for b in ("ra", "ste", "gli", "dro", "pu", "ve") for c in ("n", "k", "ll", "x", "m")]
    texts += [f"see {a}{b}@example.com now" for a in "uvwxyz" for b in "0123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == len(texts) == 360 and not set(got) & set(texts)
    assert all(pii_kind in x for x, pii_kind in zip(got, ["Mrs "] * 150 + ["Господин "] * 150 + ["@"] * 60))


def test_pii_by_brute_force(spark):
    """Of every text: what lies between entities stays, entities are replaced, one surrogate for each and each its own."""
    import regex
    from pyspark.sql import functions as F

    found = regex.compile(pii.ANY.replace("\\p{IsCyrillic}", "\\p{Cyrillic}"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    long_ = " ".join(f"word{k} Mrs Name{chr(97 + k % 26)} a{k % 50}@b.org 10.0.{k % 7}.9" for k in range(2000))
    docs = docs.union(spark.createDataFrame([(-1, long_), (-2, None), (None, "Mr Null")], "doc_id long, text string")).cache()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    pairs = set()
    for i, t in before.items():
        if t is None:
            assert after[i] is None
            continue
        a, b = [m.span() for m in found.finditer(t)], [m.span() for m in found.finditer(after[i])]
        assert len(a) == len(b)
        gaps = lambda text, at: [text[x:y] for x, y in zip([0, *(e for _, e in at)], [*(s for s, _ in at), len(text)])]
        assert gaps(t, a) == gaps(after[i], b)
        pairs |= {(t[x:y], after[i][u:v]) for (x, y), (u, v) in zip(a, b)}
    df = spark.createDataFrame([(x, y) for x, y in pairs], "old string, new string")
    forms = df.select(*(F.concat_ws("|", pii.kind_of(F.col(c)), pii.normal(pii.kind_of(F.col(c)), F.col(c))).alias(c) for c in ("old", "new"))).distinct().collect()
    assert len({r["old"] for r in forms}) == len({r["new"] for r in forms}) == len(forms) > 60 and not {r["old"] for r in forms} & {r["new"] for r in forms}


def test_chat_with_long_conversations_and_clashing_names(spark):
    given = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|end|>") for k in range(3000)] + [(2, 0, "assistant", "é\\" * 400_000)]
    df = spark.createDataFrame([(*g, 7, "x", None) for g in given], "conv_id long, turn long, role string, text string, loss_start long, formatted string, end string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 3000 and got[2]["loss_chars"] == 800_000
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for _, k, _, t in given[:3000] if k % 2).encode()).hexdigest()


def test_warc_of_empty_tables_clashing_names_and_long_pages(spark):
    schema = "page_id long, url string, html string, key string, record string, payload int, record_type string"
    args = ("page_id", "record_id", "url", "date", "headers", "html")
    assert warc.derivatives(warc.responses_of(spark.createDataFrame([], schema)), *args).count() == 0
    page = "<p>" + "long text <b>here</b> " * 100_000
    df = spark.createDataFrame([(1, "u", page, "k", "r", 1, "t"), (1, "u", page, "k", "r", 1, "t"), (None, "u", "x", None, None, None, None)], schema)
    got = warc.derivatives(warc.responses_of(df), *args).collect()
    assert len(got) == 6 and Counter(r["page_id"] for r in got) == {1: 4, None: 2}
    assert max(r["content_length"] for r in got) == len(("long text here " * 100_000).strip())


def test_warc(spark):
    page = "<html lang='de'><head><title>A &amp; B</title><script>x<y</script></head><body><p>One<br>two &lt;3<a href=\"/q?a=1&amp;b\">l</a></p><!-- c --></body></html>"
    df = spark.createDataFrame([(1, "http://x/", page, "c"), (2, None, None, "c"), (3, "u", "plain", "c")], "page_id long, url string, html string, record string")
    got = warc.derivatives(warc.responses_of(df), "page_id", "record_id", "url", "date", "headers", "html").collect()
    assert len(got) == 6
    source = {r["page_id"]: r["record_id"] for r in warc.responses_of(df).collect()}
    for r in got:
        fields, block = warc.parse(bytes(r["record"]))
        assert fields["WARC-Refers-To"] == r["refers_to"] == source[r["page_id"]] and fields["WARC-Record-ID"] == r["record_id"]
        assert fields["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"]
        assert fields["WARC-Refers-To-Payload-Digest"] == r["source_payload_digest"]
        if r["page_id"] == 1:
            assert block == (b"One\ntwo <3l" if r["record_type"] == "conversion" else block)
            if r["record_type"] == "metadata":
                assert b"title: A & B\r\n" in block and b"language: de" in block and b"outlink: /q?a=1&b" in block and b"source-status: HTTP/1.1 200 OK" in block
    assert len({r["record_id"] for r in got}) == 6


def plain_patterns(page):
    """What warc's scans find, by backtracking patterns: text, title, language, links."""
    import html

    hidden = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>")
    titles = re.compile(r"(?is)<title\b[^>]*>(.*?)</title\s*>")
    t, lang = titles.search(page), re.search(r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", page)
    links = re.findall(r"(?is)<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", page)
    text = titles.sub(" ", hidden.sub(" ", page))
    text = html.unescape(warc._TAG.sub("", warc._BREAK.sub("\n", text)))
    text = warc._LINES.sub("\n", warc._SPACES.sub(" ", text)).strip()
    return text, html.unescape(t[1]).strip() if t else "", lang[1] if lang else "", [html.unescape(next(filter(None, x), "")) for x in links]


def test_warc_scans_find_what_patterns_find(spark):
    import random

    rnd = random.Random(7)
    bits = ["<script>", "</script>", "</SCRIPT >", "<style a>", "</style>", "<!--", "-->", "<title>", "<title x>", "</title>", "<html lang='de'>", "<html x lang=en-GB lang=fr>", "<html ", "<a href='x'>", '<a class=b href="/y?a&amp;b">', "<a href=z>", "<a ", "<a href=", "<abbr>", "href=q", ">", "<", "<p>", "</p>", "<br/>", "text", " ", "\n", "a < b", "&lt;", '"', "'", "<b>", "</b"]
    pages = ["".join(rnd.choices(bits, k=rnd.randint(1, 25))) for _ in range(4000)] + [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages:
        assert (warc.plain_text(page), warc.title_of(page), warc.language_of(page), warc.links_of(page)) == plain_patterns(page), page


@pytest.mark.parametrize("bit", ["<script>", "<!--", "<title>", "<a href='", "<a ", "<html ", "<html lang", "<p", "<", "</script", "<template><script>", "<a href=> ", "&"])
def test_warc_scans_are_linear(bit):
    import time

    page = bit * (1_000_000 // len(bit))
    t = time.perf_counter()
    warc.plain_text(page), warc.title_of(page), warc.language_of(page), warc.links_of(page)
    assert time.perf_counter() - t < 5


def test_classifier(spark):
    from pyspark.sql import functions as F

    got = queries.op8_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    test = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in classifier.score(docs, labels, F.lit(True)).collect()] == [0.5, 0.5]
    assert zlib.crc32(b"17") % 5 == spark.range(17, 18).select((F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("x")).first()["x"]
    assert classifier.score(docs.limit(0), labels, F.lit(True)).count() == 0
    a = np.array([1.0, 0, 2, 3]), np.array([2.0, 2, 0, 3])
    assert (np.diff(classifier.isotonic(*a)) >= 0).all()


def test_classifier_with_repeated_labels_nulls_and_clashing_names(spark):
    from pyspark.sql import functions as F

    texts = {k: ("plain words in a quiet sentence that goes on. " * 6 if k % 2 else "@@ ## BUY $$ now!!! " * 9) + str(k) for k in range(40)}
    texts |= {40: None, 41: "", 42: "word " * 200_000}
    docs = spark.createDataFrame([(k, t, 1.0, 2) for k, t in texts.items()] + [(None, "x", 1.0, 2), (3, texts[3], 1.0, 2)], "doc_id long, text string, score double, label int").withColumn("stats", F.lit(0))
    rows = [(k, k % 2) for k in range(40)] + [(5, 0), (5, 1), (6, None), (7, 9), (999, 1), (None, 1)]
    labels = spark.createDataFrame([(d, q, "s") for d, q in rows], "doc_id long, quality int, stats string")
    got = classifier.score(docs, labels, F.lit(True)).collect()
    assert len(got) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert min(by[k] for k in range(1, 40, 2)) > max(by[k] for k in range(0, 40, 2))
    once = classifier.score(docs, labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")), F.lit(True)).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in once} == {k: round(v, 9) for k, v in by.items()}
    kept = classifier.keep_good(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(1, 40, 2))
