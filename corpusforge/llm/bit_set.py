"""A set of hashes as one row of bits: of fixed size, so that it may be broadcast whatever the number of hashes.

It tells which rows can't have a partner in a join, before they are shuffled. It never decides a result:
a full set only lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23


def bit_set(hashes: DataFrame) -> DataFrame:
    """One row (words: 2**BITS / 64 longs) with the bits of the first column of `hashes` (long hashes)."""
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - BITS)
    some = hashes.select(place.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bits"))
    every = hashes.sparkSession.range(1 << BITS - 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).unionByName(every).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def maybe_in(df: DataFrame, hashed: Column, held: DataFrame, kind: str = "left_semi") -> DataFrame:
    """The rows of `df` whose long hash may be in `held` (of bit_set): all that are in it, and few others.

    With kind left_anti those that can't be in it. `hashed` may not be null.
    """
    place = F.shiftrightunsigned(hashed, 64 - BITS)
    word = F.get(F.col("words"), F.shiftright(place, 6).cast("int"))
    return df.join(F.broadcast(held), F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1, kind)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose `key` is not in the one column of `ids`; only those that may be in it are shuffled."""
    held, hashed = bit_set(ids.select(F.xxhash64(ids.columns[0]))), F.xxhash64(key)
    maybe = maybe_in(df, hashed, held).join(ids, F.col(key) == F.col(ids.columns[0]), "left_anti")
    return maybe_in(df, hashed, held, "left_anti").unionByName(maybe)
