"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per document: counts of words, word characters, symbols, repeated lines and words in repeated
three-word windows. Across documents: lines are normalised (lower case, single spaces, digits
alike) and hashed, and the distinct documents (by id and text) that hold a line are counted per host:
exact copies under ids of their own count, a repeated row doesn't. Lines above the limit are removed,
and a document that keeps too few of its words is rejected.

Scale: line counts are combined map-side, over (host, line, document) and then (host, line), so a host
or a line that a third of the documents share doesn't land in one task; the lines above the limit
come back by a join that the runtime may broadcast below its threshold and splits where skewed.
Texts themselves are never shuffled.

Defined cases: null or empty text has no words and fails the base rules; a null host is the host
''; repeated rows (also null ids with equal text) get the same verdict, each line's words counted once; null ids are kept as they are; an empty table gives an
empty result. Columns other than id, text and host are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line that more distinct documents of a host hold is removed.
MAX_LINE_TEXTS = 20
#: A document is depleted below this part of its words, or below MIN_WORDS.
MIN_LEFT_PERCENT = 50


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) from `text`."""
    text = F.col("text")
    rest = docs.columns
    d = docs.select(*rest, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    d = d.select(*rest, "_w", lines.alias("_lines"))
    # Hash of each window with its place, sorted by hash: equal windows are neighbours.
    window = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")))
    chars = F.length(F.array_join("_w", "")).cast("long").alias("word_chars")
    d = d.select(*rest, F.size("_w").cast("long").alias("n_words"), chars, (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.sort_array(window).alias("_s"))
    again = F.transform("_s", lambda x, i: F.when((x["h"] == F.get("_s", i + 1)["h"]) | (x["h"] == F.get("_s", i - 1)["h"]), x["p"]))
    d = d.select(*rest, "n_words", "word_chars", "n_dup_lines", F.sort_array(F.filter(again, lambda p: p.isNotNull())).alias("_p"))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return d.select(*rest, "n_words", "word_chars", (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"), "n_dup_lines", covered.alias("n_repeat_words"))


def _normal(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def _line_hash(line):
    return F.xxhash64(_normal(line))


def line_rows(docs: DataFrame) -> DataFrame:
    """host, doc_id, text_key, place, line (hash), words: one row for each line with a word."""
    d = docs.select("host", "doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    d = d.select("host", "doc_id", "text_key", "place", _normal(F.col("line")).alias("line")).filter(F.col("line") != "")
    return d.select("host", "doc_id", "text_key", "place", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"))


def frequent_lines(rows: DataFrame, max_texts: int) -> DataFrame:
    """host, line of the lines that more than max_texts distinct documents of the host hold."""
    return rows.select("host", "line", "doc_id", "text_key").distinct().groupBy("host", "line").count().filter(F.col("count") > max_texts).select("host", "line")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_texts: int = MAX_LINE_TEXTS, min_words: int = MIN_WORDS, min_left_percent: int = MIN_LEFT_PERCENT, max_repeat_percent: int = MAX_REPEAT_PERCENT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, n_words_removed, kept; with_text
    also the text without the removed lines."""
    src = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"))
    src = src.withColumn("text_key", F.xxhash64("text", F.length("text")))
    rows = line_rows(src)
    gone = rows.join(frequent_lines(rows, max_line_texts), ["host", "line"])
    # A set of places: a repeated row holds the same ones, so its words count once.
    words = F.aggregate(F.collect_set(F.struct("place", "words")), F.lit(0).cast("long"), lambda n, x: n + x["words"])
    gone = gone.groupBy("host", "doc_id", "text_key").agg(words.alias("_gone"), *([F.collect_set("line").alias("_lines")] if with_text else []))
    gone = gone.select(F.col("host").alias("_host"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_gone", *(["_lines"] if with_text else []))
    base = base_counts(src)
    base = base if with_text else base.drop("text")
    out = base.join(gone, base["text_key"].eqNullSafe(F.col("_key")) & base["doc_id"].eqNullSafe(F.col("_id")) & (base["host"] == F.col("_host")), "left")
    removed = F.coalesce("_gone", F.lit(0))
    left = F.col("n_words") - removed
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed & (left >= min_words) & (100 * left >= min_left_percent * F.col("n_words"))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), removed.cast("long").alias("n_words_removed"), kept.alias("kept")]
    if with_text:
        cols.append(F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(F.array_contains("_lines", _line_hash(x)), F.lit(False))), "\n").alias("text"))
    return out.select(*cols)
