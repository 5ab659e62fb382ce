"""The pipeline's stages, each on its own input, against brute force."""

import re

import pytest

pytest.importorskip("factloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_duplicates import brute_components, brute_dedup, in_order  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns
    assert sum(d in kept for d, q in labels.items() if q) >= 0.97 * sum(labels.values())
    assert sum(d not in kept for d, q in labels.items() if not q) >= 0.6 * sum(not q for q in labels.values())
    single = corpus_pipeline.near_duplicates(spark, good, SF).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 4, 5)
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {c for _, _, c in want}
    cut = corpus_pipeline.repeated_passages(spark, single, SF).cache()
    left = {d: (n, gone) for d, n, gone, _, _ in brute_dedup(in_order(single), corpus_pipeline.REPEATED_BYTES)}
    assert cut.columns == columns and {r["doc_id"] for r in cut.collect()} == {d for d, (n, gone) in left.items() if not n or gone < n}
    for r in cut.collect():
        n, gone = left[r["doc_id"]]
        assert n - gone - 6 * 4 <= len(r["text"].encode()) <= n - gone and r["n_chars"] == len(r["text"])
    private = corpus_pipeline.personal_data(spark, cut, SF).cache()
    before = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert private.columns == columns and private.count() == len(before)
    for r in private.collect():
        for found in re.findall(r"[\w.]+@[\w.]+|\d{16}|\b[0-9a-f]{40}\b", before[r["doc_id"]]):
            assert found not in r["text"]
    packed = corpus_pipeline.packed(spark, private, SF).collect()
    assert {r["doc_id"] for r in packed} == set(before) and all(len(r["ids"]) == r["length"] for r in packed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_stages_take_hostile_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, and extra columns named like the stages' own, on each stage's input."""
    names = ("_kept", "_nth", "_row", "_text", "_found", "_new", "carried", "kept", "named", "tie", "node", "stats", "score", "ids")
    given = [(1, "a plain text with enough words to be one " * 9, "en", "s", 9), (1, "a plain text with enough words to be one " * 9, "en", "s", 9), (2, None, None, None, None), (None, "no id here " * 30, "en", None, 3), (None, "no id here " * 30, "en", None, 3), (3, "", "en", "s", 0), (4, "x" * 100_000, "en", "s", 100_000), (5, "Mrs Ann Lee, 10.0.0.1 " * 40, "en", "s", 1)]
    docs = spark.createDataFrame([(*g, *range(len(names))) for g in given], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)).cache()
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        n = {name: stage(spark, table, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
        for name, out in n.items():
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert bool(rows) == (table is docs)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 3, 4, 5, None, None]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert cut[2] == "" and cut[3] == "" and "a plain text" in cut[1]
    private = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, str(tmp_path)).collect()}
    assert private[2] is None and "Ann" not in private[5] and private[4] == "x" * 100_000
