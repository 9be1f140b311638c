"""Content-addressed blobs, references to them, and a receipt with all that belongs to it."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def put(blobs: DataFrame, key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each content: of equal ones the first by order."""
    w = Window.partitionBy(key).orderBy(*order)
    return blobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r") if order else blobs.dropDuplicates([key])


def shard_path(digest: Column) -> Column:
    """Where a blob is kept: two levels of two hex digits ahead of its name."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


#: Bytes of a file that is read at most.
LARGEST = 64 * 1024 * 1024


def read_images(spark, path: str, largest: int = LARGEST) -> DataFrame:
    """A row for every file under path: its digest, size and type, or in error why there is none.

    Files are listed first and read apart from that, and what cannot be read is passed over: a file that is gone,
    empty or damaged has the error unreadable, one over largest is not read at all, and neither keeps the others from coming in.
    """
    named = lambda f: re.sub("^file:/+", "file:/", unquote(f))  # noqa: E731  as the column path has it
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(path)
    listed = spark.createDataFrame([(named(f),) for f in files.inputFiles()], "path string")  # names, which the scan lists as well
    sized, read = files.select("path", "length"), files.where(F.col("length") <= largest).select("path", "content")
    start = F.hex(F.substring("content", 1, 4))
    kind = F.when(start.startswith("FFD8FF"), "image/jpeg").when(start == "89504E47", "image/png")
    error = F.when(F.col("length") > largest, "too large").when(F.col("content").isNull(), "unreadable").when(kind.isNull(), "not an image")
    return listed.join(sized, "path", "left").join(read, "path", "left").select("path", F.sha2("content", 256).alias("id"), F.col("length").alias("byte_size"), kind.alias("mime_type"), error.alias("error"))


def write_sharded(blobs: DataFrame, path: str) -> None:
    """Writes blobs whose digest holds into folders by the first two hex digits."""
    blobs.where(F.sha2("content", 256) == F.col("id")).withColumn("shard", F.substring("id", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def referenced(receipts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct blob ids that any of the columns names."""
    parts = [receipts.select(F.col(c).alias("id")) for c in columns]
    return reduce(DataFrame.unionByName, parts).where("id is not null").distinct()


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    return blobs.join(references, "id", "left_anti")


def missing(wanted: DataFrame, blobs: DataFrame, most: int | None = None) -> DataFrame:
    """Wanted ids that are not stored, by id; with most, so many of them."""
    out = wanted.join(blobs, "id", "left_anti").distinct()
    return out.orderBy("id").limit(most) if most else out


def status(asked: DataFrame, blobs: DataFrame) -> DataFrame:
    """Asked ids and whether each is present."""
    there = blobs.select("id").distinct().withColumn("_there", F.lit(True))
    return asked.select("id").distinct().join(there, "id", "left").select("id", F.coalesce("_there", F.lit(False)).alias("present"))


def size(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def discardable(receipts: DataFrame) -> DataFrame:
    """Originals of parsed or confirmed receipts that are not also the image or the thumbnail."""
    o = F.col("original_image_id")
    return receipts.where(F.col("status").isin("parsed", "confirmed") & o.isNotNull() & ~o.eqNullSafe(F.col("image_id")) & ~o.eqNullSafe(F.col("thumb_id"))).select("id", o.alias("blob_id"))


def bundle(receipts: DataFrame, items: DataFrame, links: DataFrame, tags: DataFrame, companies: DataFrame, receipt_id: int) -> DataFrame:
    """One receipt with its items in printed order, its live tags by name and its company if that is live."""
    one = receipts.where(F.col("id") == receipt_id)
    lines = items.where(F.col("receipt_id") == receipt_id).groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "name", "total_price"))).alias("items"))
    named = links.where(F.col("receipt_id") == receipt_id).join(tags.where("deleted_at = 0").select(F.col("id").alias("tag_id"), F.col("name").alias("_tag")), "tag_id")
    marks = named.groupBy("receipt_id").agg(F.array_sort(F.collect_list("_tag")).alias("tags"))
    company = companies.where("deleted_at = 0").select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return one.join(lines, one["id"] == lines["receipt_id"], "left").drop("receipt_id").join(marks, F.col("id") == marks["receipt_id"], "left").drop("receipt_id").join(company, "company_id", "left")


def tag_changes(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """What to do with each link of (receipt_id, tag_id): add, revive, keep, remove; links has deleted_at."""
    w, have = wanted.select("receipt_id", "tag_id", F.lit(True).alias("_w")), links.select("receipt_id", "tag_id", "deleted_at")
    both = w.join(have, ["receipt_id", "tag_id"], "full")
    action = (
        F.when(F.col("_w").isNotNull() & F.col("deleted_at").isNull(), "add")
        .when(F.col("_w").isNotNull() & (F.col("deleted_at") != 0), "revive")
        .when(F.col("_w").isNotNull(), "keep")
        .when(F.col("deleted_at") == 0, "remove")
    )
    return both.select("receipt_id", "tag_id", action.alias("action")).where("action is not null")


def restore(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Items that a receipt's own deletion took with it; others stay deleted."""
    r = receipts.select(F.col("id").alias("receipt_id"), F.col("deleted_at").alias("_at")).where("_at <> 0")
    return items.join(r, "receipt_id").where(F.col("deleted_at") == F.col("_at")).drop("_at").withColumn("deleted_at", F.lit(0).cast("bigint"))


def without_category(df: DataFrame, category: str) -> DataFrame:
    return df.withColumn("category_id", F.when(F.col("category_id") == category, None).otherwise(F.col("category_id")))


def purgeable(df: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Tombstones older than so many days that the server knows."""
    return df.where((F.col("deleted_at") > 0) & (F.col("deleted_at") < now - days * 86_400_000) & (F.col("dirty") == 0) & (F.col("rev") > 0))


def log_tail(log: DataFrame, rows: int = 500, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest entries. A limit over an order keeps so many rows in each task and merges those."""
    return log.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(rows)
