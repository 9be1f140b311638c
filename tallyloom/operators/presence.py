"""Which ids are among others, with a bit set of one side ahead of the exact join.

Tasks hash the ids of the smaller side to bits and an aggregate puts their words together, so what comes to the driver
is the bit set and not the ids. An id whose bits are not all set is absent for certain and needs no join; the others are
joined exactly, so the result does not depend on the filter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each id, hashes of each, and bits at most: beyond them a filter would let too much through and is left out.
BITS, HASHES, MOST_BITS = 10, 7, 1 << 28


@dataclass(frozen=True)
class Members:
    """A bit set of ids; words of 64 bits, their number a power of two."""

    words: np.ndarray

    @classmethod
    def of(cls, ids: DataFrame, column: str = "id", rows: int | None = None, most_bits: int = MOST_BITS) -> Members | None:
        """The bit set of a column's values, nulls left out; None if they need more than most_bits."""
        rows = ids.count() if rows is None else rows
        size = 1 << max(6, math.ceil(math.log2(max(1, rows) * BITS)))
        if size > most_bits:
            return None
        one, two = _hashes(F.col(column))
        places = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: _place(one, two, k, size))
        bits = ids.where(F.col(column).isNotNull()).select(F.explode(places).alias("p"))
        bits = bits.select(F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("bit"))
        found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most most_bits / 64 rows
        words = np.zeros(size // 64, np.int64)
        words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        return cls(words)

    def may_hold(self, value: Column) -> Column:
        """Whether a value may be among the ids; false is certain. Nulls never are."""
        words, size = self.words, self.words.size * 64

        @F.pandas_udf("boolean")
        def probe(one: pd.Series, two: pd.Series) -> pd.Series:
            a, b = one.to_numpy(np.int64), two.to_numpy(np.int64)
            hit = np.ones(len(a), bool)
            with np.errstate(over="ignore"):
                for k in range(HASHES):
                    p = (a + k * b) & (size - 1)
                    hit &= (words[p >> 6] >> (p & 63)) & 1 == 1
            return pd.Series(hit)

        one, two = _hashes(value)
        return F.when(value.isNull(), False).otherwise(probe(one, two))


def _hashes(value: Column) -> tuple[Column, Column]:
    """Two hashes of 31 bits, whose sums give all places of an id."""
    h = F.xxhash64(value.cast("string"))
    return F.shiftrightunsigned(h, 33), F.shiftrightunsigned(F.shiftleft(h, 31), 33).bitwiseOR(F.lit(1))


def _place(one: Column, two: Column, k: Column, size: int) -> Column:
    return (one + k * two).bitwiseAND(F.lit(size - 1))


def present(asked: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Distinct asked keys and whether each is among those of stored.

    The filter is made of the smaller side. Made of what is asked it keeps the stored ids that nobody asks for out of the
    join; made of what is stored it answers most absent ids on the spot. Null keys are left out.
    """
    wanted = asked.select(key).where(F.col(key).isNotNull()).distinct()
    there = stored.select(key).where(F.col(key).isNotNull())
    n, m = wanted.count(), there.count()
    members = Members.of(wanted, key, n) if n <= m else Members.of(there, key, m)
    absent = None
    if members and n <= m:
        there = there.where(members.may_hold(F.col(key)))
    elif members:
        marked = wanted.withColumn("_may", members.may_hold(F.col(key)))
        absent = marked.where(~F.col("_may")).select(key, F.lit(False).alias("present"))
        wanted = marked.where("_may").select(key)
    exact = wanted.join(there.distinct().withColumn("_there", F.lit(True)), key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("present"))
    return exact if absent is None else absent.unionByName(exact)


def missing(wanted: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Distinct wanted keys that are not among those of stored."""
    return present(wanted, stored, key).where(~F.col("present")).select(key)
