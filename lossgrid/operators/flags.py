"""A bounded set of hashes to broadcast: which rows may need a closer look.

The hashes are folded to ``bits`` positions and kept as 64-bit words, so the
table has at most ``bits / 64`` rows of 16 bytes (4 MB at the default, mostly
far fewer) whatever the size of the input.  A row that is not flagged is
certainly not in the set; a flagged one may be, and whoever asks decides it
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def _word(value: Column, bits: int) -> Column:
    return F.call_function("shiftright", value.bitwiseAND(F.lit(bits - 1).cast("long")), F.lit(6)).cast("int")


def _bit(value: Column) -> Column:
    return value.bitwiseAND(F.lit(63).cast("long")).cast("int")


def flag_words(hashes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``_word, _mask``: the positions of the long hashes in ``column``; at most ``bits / 64`` rows.

    ``bits`` is a power of two from 64 on.
    """
    value = F.col(column)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(value))
    return hashes.groupBy(_word(value, bits).alias("_word")).agg(F.bit_or(one).alias("_mask"))


def with_flag(rows: DataFrame, value: Column, words: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with the boolean ``_flagged``: whether ``value`` (long, never null) may be among the hashes."""
    joined = rows.join(F.broadcast(words), _word(value, bits) == F.col("_word"), "left")
    bit = F.getbit("_mask", _bit(value))
    return joined.withColumn("_flagged", F.coalesce(bit, F.lit(0)) == 1).drop("_word", "_mask")
