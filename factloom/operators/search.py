"""Retrieval: searchable documents, BM25 by a scan, exact cosine search, embeddings and their coverage. The index is in index.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..functions.values import cosine
from ..memory import Memory
from .index import K1, B, counted


def search_documents(memory: Memory) -> DataFrame:
    """entity_type, node_id, field, privacy, text: a document per searchable string attribute."""
    out = None
    for e in memory.entities.values():
        for f in e.fields.values():
            if f.searchable and f.kind == "string":
                one = e.df.filter(F.col(f"p_{f.name}") & F.col(f"v_{f.name}").isNotNull())
                one = one.select(F.lit(e.name).alias("entity_type"), F.col("id").cast("string").alias("node_id"), F.lit(f.name).alias("field"), F.when((F.col("privacy") == "private") | F.lit(f.privacy == "private"), "private").otherwise("public").alias("privacy"), F.col(f"v_{f.name}").alias("text"))
                out = one if out is None else out.unionByName(one)
    if out is None:
        raise QueryValidationError("nothing is searchable")
    return out


def index(documents: DataFrame, text: str = "text", key: list[str] | None = None) -> DataFrame:
    """Postings: key columns, token, tf, dl (words of the document), made in a map."""
    key = key or ["entity_type", "node_id", "field"]
    each = counted(documents, key, text).select(*key, "dl", F.explode("tokens").alias("x"))
    return each.select(*key, "dl", "x.token", "x.tf")


def _uses(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def fts(documents: DataFrame, terms: list[str], key: list[str], k: int | None = None, text: str = "text") -> DataFrame:
    """Documents that hold all terms, with their BM25 score, best first. The statistics (documents, mean
    length, documents per term) are over all documents, in the same pass that counts the terms."""
    terms = sorted({t.lower() for t in terms})
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    docs = documents.select(*key, words.alias("w"))
    tfs = [_uses(t) for t in terms]
    docs = docs.select(*key, F.size("w").alias("dl"), *(c.alias(f"tf{i}") for i, c in enumerate(tfs)))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = docs
    for i in range(len(terms)):
        hits = hits.filter(F.col(f"tf{i}") > 0)
    hits = hits.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1.0)
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    out = hits.select(*key, score.alias("score"))
    return out.orderBy(F.desc("score"), *key).limit(k) if k else out


def semantic_top_k(vectors: DataFrame, query: list[float], key: str, vector: str, k: int, where: Column | None = None, dims: int | None = None) -> DataFrame:
    """Exact cosine: key, score of the k nearest, by (-score, key). A top-k per task, no shuffle of vectors.
    where: the rows that take part (entity types, public ones, fields). dims: a query of another size raises, and
    so does a vector."""
    if dims is not None and len(query) != dims:
        raise QueryValidationError(f"the query has {len(query)} dimensions, not {dims}")
    rows = vectors if where is None else vectors.filter(where)
    col = F.col(vector)
    if dims is not None:
        col = F.when(F.size(col) == dims, col).otherwise(F.raise_error(F.lit(f"a vector hasn't {dims} dimensions")).cast(vectors.schema[vector].dataType))
    return rows.select(key, cosine(col, query).alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(k)


def embedding_profile(records: DataFrame) -> DataFrame:
    """profile, dims, n_records, n_documents: what embedding records (profile, key columns, content_hash, embedding) there
    are. More than one row of a profile tells that its dimensions are mixed."""
    rest = [c for c in records.columns if c not in ("profile", "content_hash", "embedding")]
    return records.groupBy("profile", F.size("embedding").alias("dims")).agg(F.count("*").alias("n_records"), F.count_distinct(*rest).alias("n_documents"))


def embedding_coverage(documents: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """status, n: of the documents, private (never embedded), ready (a record of the current text), stale (only
    of an earlier text) or missing; and of the records, orphaned (no public document)."""
    docs = documents.select(*key, F.sha2("text", 256).alias("now"), (F.col("privacy") == "public").alias("open"))
    have = records.groupBy(*key).agg(F.collect_set("content_hash").alias("had"))
    both = docs.join(have, key, "full")
    status = (
        F.when(F.col("open").isNull() | ~F.col("open") & F.col("had").isNotNull(), "orphaned").when(~F.col("open"), "private").when(F.col("had").isNull(), "missing")
        .when(F.array_contains("had", F.col("now")), "ready").otherwise("stale")
    )
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def missing_embeddings(documents: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """Public documents whose current text has no embedding record (key, content_hash)."""
    docs = documents.filter("privacy = 'public'").withColumn("content_hash", F.sha2("text", 256))
    return docs.join(records.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")


def embed(documents: DataFrame, provider, key: list[str], batch: int = 64) -> DataFrame:
    """key, content_hash, embedding by a provider(list of texts) -> list of vectors, in batches."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*key).schema) + ", content_hash string, embedding array<float>"

    def run(batches):
        for pdf in batches:
            vectors = []
            for i in range(0, len(pdf), batch):
                vectors += provider(pdf["text"].iloc[i : i + batch].tolist())
            yield pdf[[*key, "content_hash"]].assign(embedding=vectors)

    return documents.withColumn("content_hash", F.sha2("text", 256)).select(*key, "content_hash", "text").mapInPandas(run, schema)
