"""Corpus pipeline: quality classifier, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as
Parquet in the shared folder and reads them as the next one's docs. All but the last return the
columns of documents. Near duplicates are texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more; the document with the least id of each group stays. Repeated passages
are strings of 200 bytes (30 to 40 words) or more that start earlier too; a document of which
nothing is left goes.

Every stage takes any table with the columns of documents. Null texts: the classifier scores them like empty ones,
near duplicates and surrogates leave them, passages are cut from an empty text, packing gives their end id alone. Rows with a null
id all pass the second stage; of rows that repeat an id it keeps the first by text. Repeated rows, empty tables, very long texts
and extra columns of any name pass through each stage.

ORACLE_SQL is None: SQL can't express the classifier's features, the suffix order or the tokenizer.
tests/llm/test_pipeline.py holds every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import classifier, jaccard_join, packing, pii, suffix_dedup
from factloom.llm.staging import staged

ORACLE_SQL = None
#: Repeated strings that are removed.
REPEATED_BYTES = 200
SURROGATE_KEY = "factloom"
#: Text that Spark passes to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Spark pass no more than BATCH_BYTES at once to a Python worker, if the session allows more: its default
    of 64 MB is held several times over by each task, in the executor and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1; learned from all labels."""
    small_batches(spark)
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    small_batches(spark)
    return jaccard_join.keep_one(docs, n=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur earlier; a character of which a cut leaves only some bytes goes too."""
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffix_dedup.dedup_substrings(docs, length=REPEATED_BYTES, carry=others, as_text=True)
    left = left.filter("n_bytes = 0 or n_removed < n_bytes")
    cols = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*(cols.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars, where there is one, counts the new text."""
    out = pii.pseudonymise(docs, key=SURROGATE_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in windows of 2048."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
