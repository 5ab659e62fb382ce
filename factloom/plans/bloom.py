"""A Bloom filter of bounded size: rows that a join would only pass by, or drop, stay out of its shuffle.

The filter is a table of 64-bit words, probed by broadcast joins: at most MOST_BITS / 64 = 2^20 rows of two numbers, whatever the tables'
size. It only ever lets more rows through than needed, so the exact join has to follow. Nulls are treated as a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import written

#: Sizes of a filter, in bits: at least eight per row within these.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
PROBES = (1, 2)


class Likely:
    """The filter of a table's values of some columns."""

    def __init__(self, df: DataFrame, *key: str, rows: int | None = None):
        self.bits = min(max(1 << int((df.count() if rows is None else rows) * 8).bit_length(), LEAST_BITS), MOST_BITS)
        each = df.select(F.explode(F.array(*(self._place(key, k) for k in PROBES))).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
        self.words = written(each.groupBy(F.shiftright("at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "filter")

    def _place(self, columns: tuple[str, ...], probe: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(c) for c in columns), F.lit(probe)), F.lit(self.bits))

    def of(self, rows: DataFrame, *value: str) -> DataFrame:
        """The rows whose values the table has, and few others."""
        for k in PROBES:
            at = self._place(value, k)
            held = F.getbit("_bits", at.bitwiseAND(F.lit(63)).cast("int")) == 1
            rows = rows.join(F.broadcast(self.words), (F.shiftright(at, 6) == F.col("_word")) & held, "left_semi")
        return rows

    def parted(self, rows: DataFrame, *value: str) -> tuple[DataFrame, DataFrame]:
        """of(), and all other rows, whose values the table surely doesn't have."""
        every, found = rows, F.lit(True)
        for k in PROBES:
            at = self._place(value, k)
            own = F.broadcast(self.words.select(F.col("_word").alias(f"_word{k}"), F.col("_bits").alias(f"_bits{k}")))
            every = every.join(own, F.shiftright(at, 6) == F.col(f"_word{k}"), "left")
            found &= F.coalesce(F.getbit(f"_bits{k}", at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
        return every.filter(found).select(*rows.columns), every.filter(~found).select(*rows.columns)
