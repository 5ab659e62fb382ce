"""A maintained inverted index: immutable segments of postings, delete marks, merges in tiers.

A segment is a Parquet table of key columns, token, tf, dl. Texts are dealt out by their bytes, and each task sorts the postings of
its own documents by token: postings aren't shuffled, so a token that every document holds is spread over all files, and a search reads of
each file the pages that hold its terms. A row with an empty token stands for the document itself: its number of words and the hash of its
text. The counts that scores need are observed while the segment is written.

A change writes a segment of the new texts and a table of marks: keys that are dead in all earlier segments. Segments are numbered, and marks
of number t hide a key in the segments before t. When the last FAN segments are of one size class or smaller, they are rewritten as one, with their
dead rows left out; each row is rewritten about once per class. A small manifest, replaced as a whole, says what there is, so a
reader sees one version or the next.

Nulls: a document without a text isn't one; a null in a key is a value. Equal keys are one document, of which all texts count as one change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_json
from ..memory import Memory
from ..plans.staging import passing, shared_folder
from ..sources import files

K1, B = 1.2, 0.75
#: Segments that are merged into one, and how much larger the next class is.
FAN = 4
#: Bytes of texts that make a task.
TASK_BYTES = 16 << 20
WORD = r"(?U)\w+"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def counted(documents: DataFrame, key: list[str], text: str) -> DataFrame:
    """Key columns, h (of the text), dl (words) and tokens (token, tf of each distinct word), row by row: words are sorted, and runs counted."""
    d = documents.filter(F.col(text).isNotNull()).select(*key, F.xxhash64(text).alias("h"), F.array_sort(words(text)).alias("_w"))
    heads = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    d = d.select(*key, "h", F.size("_w").alias("dl"), "_w", F.when(F.size("_w") > 0, heads).otherwise(F.array().cast("array<int>")).alias("_at"))
    each = F.transform("_at", lambda p, j: F.struct(F.get("_w", p).alias("token"), (F.coalesce(F.get("_at", j + 1), F.size("_w")) - p).alias("tf")))
    return d.select(*key, "h", "dl", each.alias("tokens"))


class TextIndex:
    """The index at a folder; key names the columns that a document is known by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = files.read_json(spark, f"{path}/manifest.json")

    @classmethod
    def create(cls, spark: SparkSession, key: list[str], path: str | None = None) -> TextIndex:
        """An empty index; without a path one that goes with the application."""
        if path is None:
            path = f"{shared_folder(spark)}/factloom-index-{uuid.uuid4().hex}"
            passing(spark, path)
        empty = {"key": key, "types": None, "segments": [], "marks": [], "next": 0, "n": 0, "words": 0, "state": None}
        files.write(spark, f"{path}/manifest.json", canonical_json(empty).encode())
        return cls(spark, path)

    @classmethod
    def build(cls, documents: DataFrame, key: list[str], path: str | None = None, text: str = "text", state: dict | None = None) -> TextIndex:
        out = cls.create(documents.sparkSession, key, path)
        out.apply(documents, None, text, state)
        return out

    @property
    def key(self) -> list[str]:
        return self.manifest["key"]

    def current(self, memory: Memory) -> bool:
        return self.manifest["state"] == memory.state()

    # -- writing ------------------------------------------------------------------------------------------------------
    def _segment(self, rows: DataFrame, number: int) -> tuple[int, int]:
        """Writes postings as a segment, sorted in the tasks that made them; its documents and their words."""
        seen = Observation()
        alone = F.col("token") == ""
        rows = rows.observe(seen, F.count_if(alone).alias("n"), F.coalesce(F.sum(F.when(alone, F.col("dl"))), F.lit(0)).alias("words"))
        rows = rows.sortWithinPartitions("token")
        rows.write.option("parquet.block.size", 16 << 20).mode("overwrite").parquet(f"{self.path}/segment-{number}")
        return seen.get["n"], seen.get["words"]

    def _counted(self, documents: DataFrame, text: str) -> DataFrame:
        """key, token, tf, dl, h: a row for each distinct word of each document, and one with an empty token. Documents are dealt out, about
        TASK_BYTES of texts to a partition, but one for each core at least; their words are counted where they lie, as the deal goes
        by the document. A task sorts all postings of its partition, so its memory is bounded, whatever splits the source has."""
        documents = documents.filter(F.col(text).isNotNull())
        size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
        n = max(1, self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        d = documents.select(*self.key, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_doc")).repartition(n, "_doc")
        d = d.select("_doc", *self.key, F.xxhash64("_text").alias("h"), words(F.col("_text")).alias("_w"))
        each = d.select("_doc", *self.key, "h", F.size("_w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "_w")).alias("token"))
        each = each.groupBy("_doc", *self.key, "h", "dl", "token").agg(F.count("*").cast("int").alias("tf"))
        own = F.col("token") == ""
        return each.select(*self.key, "token", F.when(own, 0).otherwise(F.col("tf")).alias("tf"), "dl", F.when(own, F.col("h")).alias("h"))

    def _commit(self, **changed) -> None:
        self.manifest = self.manifest | changed
        files.write(self.spark, f"{self.path}/manifest.json", canonical_json(self.manifest).encode(), replace=True)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, text: str = "text", state: dict | None = None) -> None:
        """Documents that are new or have another text, and keys that are gone. The work is that of the change."""
        m, key, number = self.manifest, self.key, self.manifest["next"]
        marks, dead = list(m["marks"]), {"n": 0, "words": 0}
        if m["segments"]:
            gone = changed.select(*key) if removed is None else changed.select(*key).union(removed.select(*key))
            old = self.documents()
            same = [old[c].eqNullSafe(gone[c]) for c in key]
            hidden = old.join(gone.distinct(), same, "left_semi").select(*key, "dl")
            seen = Observation()
            hidden = hidden.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
            hidden.select(*key).write.mode("overwrite").parquet(f"{self.path}/marks-{number}")
            dead = seen.get
            marks += [number] if dead["n"] else []
        rows = self._counted(changed, text)
        n, total = self._segment(rows, number)
        types = [changed.schema[c].dataType.simpleString() for c in key]
        segments = [*m["segments"], {"number": number, "n": n}] if n else m["segments"]
        self._commit(segments=segments, marks=marks, next=number + 1, n=m["n"] - dead["n"] + n, words=m["words"] - dead["words"] + total, types=types, state=state)
        self._merge()

    def _merge(self) -> None:
        """Rewrites the last FAN segments as one while they are of one size class or smaller ones; the last marks go with them."""
        while len(self.manifest["segments"]) >= FAN:
            last = self.manifest["segments"][-FAN:]
            if last[0]["n"] > FAN * max(s["n"] for s in last[1:]):
                return
            number, m = self.manifest["next"], self.manifest
            n, _ = self._segment(self._live(last), number)
            segments = [*m["segments"][:-FAN], *([{"number": number, "n": n}] if n else [])]
            marks = [t for t in m["marks"] if segments[:-1] or n == 0 and segments]  # marks of earlier numbers still hide what lies before
            self._commit(segments=segments, marks=marks, next=number + 1)

    # -- reading ------------------------------------------------------------------------------------------------------
    def _live(self, segments: list[dict], terms: list[str] | None = None) -> DataFrame:
        """Rows of segments that no later mark hides; of the terms alone, if they are given."""
        out, key = None, self.key
        for s in segments:
            rows = self.spark.read.parquet(f"{self.path}/segment-{s['number']}")
            if terms is not None:
                rows = rows.filter(F.col("token").isin(terms))
            marks = [t for t in self.manifest["marks"] if t > s["number"]]
            if marks:
                dead = self.spark.read.parquet(*(f"{self.path}/marks-{t}" for t in marks)).distinct()
                rows = rows.join(dead, [rows[c].eqNullSafe(dead[c]) for c in key], "left_anti")
            out = rows if out is None else out.union(rows)
        if out is None:
            types = self.manifest["types"] or ["string"] * len(key)
            out = self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in zip(key, types)) + ", token string, tf int, dl int, h long")
        return out

    def documents(self) -> DataFrame:
        """key, dl, h of the documents in the index."""
        return self._live(self.manifest["segments"], [""]).select(*self.key, "dl", "h")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """key, token, tf, dl of the terms, or of all."""
        return self._live(self.manifest["segments"], terms).filter("token <> ''").drop("h")

    def search(self, terms: list[str], k: int | None = None) -> DataFrame:
        """Key columns and score (BM25) of the documents that hold all terms, best first with k. Document frequencies come from the
        same postings."""
        terms, m = sorted({t.lower() for t in terms}), self.manifest
        found = self.postings(terms)
        df = found.groupBy("token").agg(F.count("*").alias("df"))
        idf = F.log((F.lit(m["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        mean = m["words"] / m["n"] if m["words"] else 1.0
        part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        # One row per term of the search on the broadcast side.
        each = found.join(F.broadcast(df), "token").select(*self.key, "token", part.alias("part_"))
        out = each.groupBy(*self.key).agg(F.count("*").alias("held"), F.array_sort(F.collect_list(F.struct("token", "part_"))).alias("parts"))
        out = out.filter(F.col("held") == len(terms)).select(*self.key, F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part_"]).alias("score"))
        return out.orderBy(F.desc("score"), *self.key).limit(k) if k else out

    def drift(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """key, status of what model and index disagree on: missing (not in the index), stale (of another text), extra (not in the model)."""
        now = documents.filter(F.col(text).isNotNull()).groupBy(*self.key).agg(F.bit_xor(F.xxhash64(text)).alias("_now"))
        had = self.documents().groupBy(*self.key).agg(F.bit_xor("h").alias("_had"))
        both = now.join(had, [now[c].eqNullSafe(had[c]) for c in self.key], "full")
        status = F.when(F.col("_had").isNull(), "missing").when(F.col("_now").isNull(), "extra").when(F.col("_now") != F.col("_had"), "stale")
        return both.select(*(F.coalesce(now[c], had[c]).alias(c) for c in self.key), status.alias("status")).filter("status is not null")

    def refresh(self, documents: DataFrame, text: str = "text", state: dict | None = None) -> dict:
        """Brings the index to the model's documents by the difference alone; how many documents of each status there were."""
        key = self.key
        differ = self.drift(documents, text).cache()
        try:
            counts = {r["status"]: r["count"] for r in differ.groupBy("status").count().collect()}
            if counts:
                wanted = differ.filter("status <> 'extra'").select(*key)
                changed = documents.join(wanted, [documents[c].eqNullSafe(wanted[c]) for c in key], "left_semi")
                self.apply(changed, differ.filter("status = 'extra'").select(*key), text, state)
            else:
                self._commit(state=state)
        finally:
            differ.unpersist()
        return {s: counts.get(s, 0) for s in ("missing", "stale", "extra")}

    def coverage(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """eligible, indexed, complete: the model's documents, and those whose present text the index holds."""
        off = self.drift(documents, text).filter("status <> 'extra'")
        both = documents.filter(F.col(text).isNotNull()).select(F.lit(1).alias("e"), F.lit(0).alias("off")).union(off.select(F.lit(0), F.lit(1)))
        out = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("eligible"), F.coalesce(F.sum("off"), F.lit(0)).alias("off"))
        return out.select("eligible", (F.col("eligible") - F.col("off")).alias("indexed"), (F.col("off") == 0).alias("complete"))
