"""A Bloom filter of bounded size, to keep rows out of a shuffle that a join would drop anyway.

The filter is a table of 64-bit words, probed by two broadcast semi-joins, so it takes no Python worker and
is held once an executor. Its bound is MOST_BITS / 64 = 2^20 rows of two numbers, whatever the tables' size.

Defined cases: nothing passes the filter of an empty table; nulls are treated as a value; any other columns
of either side may have any names but _word and _bits (with or without a number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Sizes of a filter, in bits: eight per row within these. Beyond, it only lets more rows through.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
PROBES = (1, 2)


def _place(column: str, probe: int, bits: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(probe)), F.lit(bits))


def _words(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The staged filter of a column's values, and its size in bits."""
    bits = min(max(1 << int(df.count() * 8).bit_length(), LEAST_BITS), MOST_BITS)
    each = df.select(F.explode(F.array(*(_place(key, k, bits) for k in PROBES))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    return staged(each.groupBy(F.shiftright("at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "filter"), bits


def likely(rows: DataFrame, value: str, df: DataFrame, key: str) -> DataFrame:
    """The rows whose value df has as key, and few others. Staged words go with the application."""
    words, bits = _words(df, key)
    for k in PROBES:
        at = _place(value, k, bits)
        held = F.getbit("_bits", at.bitwiseAND(F.lit(63)).cast("int")) == 1
        rows = rows.join(F.broadcast(words), (F.shiftright(at, 6) == F.col("_word")) & held, "left_semi")
    return rows


def parted(rows: DataFrame, value: str, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """likely() and all other rows, whose value df surely doesn't have."""
    words, bits = _words(df, key)
    every, columns, found = rows, rows.columns, F.lit(True)
    for k in PROBES:
        at = _place(value, k, bits)
        own = F.broadcast(words.select(F.col("_word").alias(f"_word{k}"), F.col("_bits").alias(f"_bits{k}")))
        every = every.join(own, F.shiftright(at, 6) == F.col(f"_word{k}"), "left")
        found &= F.coalesce(F.getbit(f"_bits{k}", at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return every.filter(found).select(*(rows[c] for c in columns)), every.filter(~found).select(*(rows[c] for c in columns))
