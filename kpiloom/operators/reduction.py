"""Reduction of a long history to what a short frame asks for.

The orders of a 30-day window are a sliver of the order history. A join alone
shuffles the whole history to find them; here a bit filter made of the window's
ids is a scalar subquery in the filter over the scan, so nearly all other rows
go before any exchange. The filter has a fixed number of bits whatever the
number of ids: what it lets pass wrongly, the join drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** POWER bits (2 MB): some 5% pass wrongly at 2 million ids; beyond some 50 million nearly all rows pass.
POWER = 24
#: Bits set for each id.
PROBES = 2


def _slots(key: Column, power: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, 31 * i).bitwiseAND((1 << power) - 1) for i in range(PROBES)]


def bit_filter(wanted: DataFrame, key: str, power: int = POWER) -> DataFrame:
    """One row with ``words``: 2 ** ``power`` bits as an array of longs, set for the ids in ``wanted[key]``.

    Bits are combined before and after the shuffle, so the last task gets at
    most one row a word of the filter (2 ** (power - 6) of them), never the ids.
    """
    spark = wanted.sparkSession
    slots = wanted.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_slots(F.col(key), power))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
    every = spark.range(1 << power - 6).join(words, F.col("id") == F.col("word"), "left")
    entry = F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["bits"]).alias("words"))


def keep_possible(history: DataFrame, on: str, wanted: DataFrame, key: str, power: int = POWER) -> DataFrame:
    """Rows of ``history`` whose ``on`` may be among ``wanted[key]``: all that are, and few that are not.

    Rows without a key go. Join the result with ``wanted`` to be exact. The two
    keys must have one type.
    """
    if history.schema[on].dataType != wanted.schema[key].dataType:
        return history
    words = bit_filter(wanted, key, power).scalar()
    hit = F.col(on).isNotNull()
    for slot in _slots(F.col(on), power):
        word = F.get(words, F.shiftright(slot, 6).cast("int"))
        hit &= F.call_function("shiftrightunsigned", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return history.filter(hit)
