"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, classifier, fingerprints, jaccard_join, packing, pii, quality_rules, repair, resampling, suffix_dedup, vector_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], given.schema)
    return chat.read_back(chat.format_turns(given.union(extra)))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="factloom")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")), "page_id", "record_id", "url", "date", "headers", "html")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~classifier.held_out())
    return scores.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_jaccard_join, op2_suffix_dedup, op3_chat_formatting, op4_pii_surrogates, op5_byte_bpe, op6_warc_derivatives, op7_fingerprints,
    op8_quality_classifier, op9_packing, op10_quality_rules, op11_conversation_repair, op12_vector_dedup, op13_importance_resampling, pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}

# -- the same by plain SQL, where SQL can say it ---------------------------------------------------------------
_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHINGLES = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 3 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words),
classes AS (SELECT min(doc_id) AS c, s, len(s) AS size FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT c, size, unnest(s) AS g FROM classes),
pairs AS (SELECT x.c AS a, y.c AS b FROM grams x JOIN grams y ON x.g = y.g AND x.c < y.c GROUP BY x.c, y.c, x.size, y.size
    HAVING 100 * count(*) >= 90 * (x.size + y.size - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(c, m) AS (SELECT c, c FROM classes UNION SELECT links.b, reached.m FROM reached JOIN links ON links.a = reached.c),
least AS (SELECT c, min(m) AS m FROM reached GROUP BY c)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(m, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN least USING (c)"""

_CONTROLS = "|".join(re.escape(x.decode()) for x in (chat.TURN, chat.TEXT, chat.END, *chat.FOREIGN))
_TURNS = "(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))"
_ESCAPED = r"length({0}) + length({0}) - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '" + _CONTROLS + "'))"
_CHAT = f"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(chat.TURN + chat.TEXT + chat.END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM {_TURNS} GROUP BY conv_id"""

_LINE = r"trim(regexp_replace(regexp_replace(lower(x), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{_WORDS}') AS w FROM docs),
base AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM docs JOIN words USING (r)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeats AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) FROM windows WHERE n > 1) GROUP BY r),
lines AS (SELECT r, doc_id, host, text, {_LINE} AS line FROM (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS x FROM docs)),
often AS (SELECT host, line FROM (SELECT DISTINCT host, line, doc_id, text FROM lines WHERE line <> '') GROUP BY ALL HAVING count(*) > {quality_rules.MAX_LINE_TEXTS}),
gone AS (SELECT r, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n FROM lines JOIN often USING (host, line) GROUP BY r),
sums AS (SELECT doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_words_removed
    FROM base LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_words_removed >= 50 AND 2 * (n_words - n_words_removed) >= n_words AS kept FROM sums"""

_VECTORS = """
WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding) AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
    WHERE list_dot_product(x.e, y.e) >= 0.98 * sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e))),
reached(v, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reached.m FROM reached JOIN links ON links.a = reached.v),
least AS (SELECT v, min(m) AS m FROM reached GROUP BY v),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, vec_id = m AS kept
FROM embeddings JOIN least ON v = vec_id LEFT JOIN degrees ON a = vec_id"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RESAMPLED = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TOKEN}') AS w FROM documents),
aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TOKEN}') AS w FROM benchmark),
source AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM docs) GROUP BY w),
target AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM aims) GROUP BY w),
hashed AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT w, hex(w) AS h, coalesce(source.n, 0) AS s, coalesce(target.n, 0) AS t FROM source FULL JOIN target USING (w)), crc),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM buckets) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM buckets) + 10000)))) AS BIGINT) AS gain FROM buckets),
sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM (SELECT r, unnest(w) AS w FROM docs) JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(g // n - CASE WHEN g % n < 0 THEN 1 ELSE 0 END, 0) AS BIGINT) AS weight,
    CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM docs LEFT JOIN sums USING (r)),
final AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS most FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM final LEFT JOIN ranked USING (r)"""

SQL = {"op12_vector_dedup": _VECTORS, "op13_importance_resampling": _RESAMPLED, "op1_jaccard_join": _SHINGLES, "op3_chat_formatting": _CHAT, "op10_quality_rules": _RULES}
