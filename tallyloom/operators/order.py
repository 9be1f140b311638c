"""Numbers and runs along a whole order, found in two passes.

Rows are sorted into ranges and written once. Each range is numbered for itself, side by side with the others, and one
small row of each, its count and what it begins and ends with, is put in sequence and carried on to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import scratch

_LOW = (1 << 33) - 1


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df in ranges of order, read back from a table: with _part, the range, and _row, the place in it from 0.

    Ranges are drawn from the data, so a bunched order has as many rows in each as an even one; only rows that are equal
    in all of order share a range whatever their number.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    at = F.monotonically_increasing_id()  # the partition in the high bits, the row's place in the low ones
    rows = dealt.sortWithinPartitions(*order).withColumn("_at", at)
    path = scratch(df.sparkSession, "ranged")
    rows.write.parquet(path)
    back = df.sparkSession.read.schema(rows.schema).parquet(path)
    return back.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_row": F.col("_at").bitwiseAND(F.lit(_LOW))}).drop("_at")


def placed(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None, base: int = 0) -> DataFrame:
    """df with the place of each row in the whole order, from base + 1 without gaps. An order that ties leaves the
    places among ties open."""
    rows = ranged(df, order, ranges)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return rows.join(starts, "_part").withColumn(name, (F.col("_ahead") + F.col("_row") + 1 + base).cast("bigint")).select(*df.columns, name)


def islands(df: DataFrame, order: list[Column], key: str, name: str = "island", ranges: int | None = None) -> DataFrame:
    """df with the number, from 1, of the run of equal keys that each row stands in along order; nulls are equal."""
    rows = ranged(df, order, ranges)
    inside = Window.partitionBy("_part").orderBy("_row")
    turn = ((F.col("_row") > 0) & ~F.col(key).eqNullSafe(F.lag(key).over(inside))).cast("int")
    rows = rows.withColumn("_turn", turn)
    parts = rows.groupBy("_part").agg(F.min_by(F.struct(key), "_row").alias("_first"), F.max_by(F.struct(key), "_row").alias("_last"), F.sum("_turn").alias("_turns"))
    along = Window.orderBy("_part")  # over one row for each range
    fresh = (~F.col("_first").eqNullSafe(F.lag("_last").over(along))).cast("int")
    parts = parts.withColumn("_fresh", fresh)
    ahead = F.coalesce(F.sum(F.col("_fresh") + F.col("_turns")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", (ahead + F.col("_fresh")).alias("_ahead"))
    run = F.sum("_turn").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).join(starts, "_part").withColumn(name, (F.col("_ahead") + F.col("_run")).cast("bigint")).select(*df.columns, name)
