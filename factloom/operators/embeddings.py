"""Embeddings of a model's texts: one per distinct text and profile, resumable, with a status.

Vectors belong to the hash of a text, so documents that share one share its vector and a text that comes back has it already. A rebuild
deals the hashes that have none into SLICES by their value and embeds a slice in a Spark job of its own, which appends a part; if the provider
fails, the parts before stay and the next call goes on with what is missing. Vectors are rounded to 32 bits and scaled to length one; one of another
length than its profile's, zero, or with a component that is no finite number fails its slice.

Status: pending (nothing yet), building (a rebuild has begun and hasn't ended), ready (every public text has its vector), degraded (a rebuild
failed, or texts have changed since).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FactloomError
from ..functions.values import canonical_json
from ..sources import files

SLICES = 8
PENDING, BUILDING, READY, DEGRADED = "pending", "building", "ready", "degraded"


def normalised(vectors: list, dims: int) -> list[list[float]]:
    """Unit vectors of 32-bit numbers."""
    x = np.array(vectors, np.float64)
    if x.ndim != 2 or x.shape[1] != dims or not np.isfinite(x).all():
        raise FactloomError(f"the provider must give finite vectors of {dims} dimensions")
    size = np.sqrt((x * x).sum(1, keepdims=True))
    if not size.all():
        raise FactloomError("a vector of length zero")
    return (x / size).astype(np.float32).tolist()


class Embeddings:
    """Records of one profile (a name and a number of dimensions) under a folder."""

    def __init__(self, spark: SparkSession, root: str, profile: str, dims: int):
        self.spark, self.folder, self.profile, self.dims = spark, f"{root}/embeddings/{profile}", profile, dims
        if files.exists(spark, f"{self.folder}/status.json"):
            if self._said()["dims"] != dims:
                raise FactloomError(f"profile {profile} has {self._said()['dims']} dimensions")
        else:
            self._say(PENDING, [])

    def _said(self) -> dict:
        return files.read_json(self.spark, f"{self.folder}/status.json")

    def _say(self, status: str, parts: list[str]) -> None:
        files.write(self.spark, f"{self.folder}/status.json", canonical_json({"status": status, "dims": self.dims, "parts": parts}).encode(), replace=True)

    def records(self) -> DataFrame:
        """content_hash, embedding."""
        parts = self._said()["parts"]
        schema = "content_hash string, embedding array<float>"
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def missing(self, documents: DataFrame) -> DataFrame:
        """content_hash, text of the distinct public texts without a vector. documents: text, privacy."""
        texts = documents.filter("privacy = 'public' and text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("text").alias("text"))
        return texts.join(self.records().select("content_hash"), "content_hash", "left_anti")

    def status(self, documents: DataFrame) -> str:
        said = self._said()["status"]
        return DEGRADED if said == READY and not self.missing(documents).isEmpty() else said

    def rebuild(self, documents: DataFrame, provider, batch: int = 64) -> int:
        """Embeds what is missing by provider(list of texts) -> list of vectors and returns how many texts that were. Raises what the provider
        raises; what was embedded before stays."""
        parts, dims, made = self._said()["parts"], self.dims, 0
        self._say(BUILDING, parts)

        def run(batches):
            for pdf in batches:
                vectors = []
                for i in range(0, len(pdf), batch):
                    vectors += normalised(provider(pdf["text"].iloc[i : i + batch].tolist()), dims)
                yield pd.DataFrame({"content_hash": pdf["content_hash"], "embedding": vectors})

        try:
            for k in range(SLICES):
                rows = self.missing(documents).filter(F.pmod(F.xxhash64("content_hash"), F.lit(SLICES)) == k)
                part = f"part-{uuid.uuid4().hex}"
                rows.mapInPandas(run, "content_hash string, embedding array<float>").write.parquet(f"{self.folder}/{part}")
                n = self.spark.read.parquet(f"{self.folder}/{part}").count()
                made, parts = made + n, [*parts, part] if n else parts
                self._say(BUILDING, parts)
        except Exception:
            self._say(DEGRADED, parts)
            raise
        self._say(READY, parts)
        return made

    def vectors(self, documents: DataFrame, key: list[str]) -> DataFrame:
        """key, embedding of the public documents whose present text has a vector."""
        docs = documents.filter("privacy = 'public'").select(*key, F.sha2("text", 256).alias("content_hash"))
        return docs.join(self.records(), "content_hash").select(*key, "embedding")
