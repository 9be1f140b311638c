"""Tables laid out for how they are read: receipts and items in the same buckets, the log in blocks of revisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Revisions in a block of the log.
BLOCK = 100_000


class Together:
    """Receipts and items as tables in as many buckets each by the receipt's id, so that lines meet their receipt, and
    are added up by it, without a shuffle. The tables belong to the session's catalogue; their files lie under path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, prefix: str | None = None) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.prefix = prefix or f"together_{uuid.uuid4().hex}"

    def write(self, receipts: DataFrame, items: DataFrame) -> Together:
        """Both tables anew. Rows are dealt to buckets ahead of the write, so each bucket is one file."""
        for name, df, key in (("receipts", receipts, "id"), ("items", items, "receipt_id")):
            dealt = df.repartition(self.buckets, key)
            dealt.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(f"{self.prefix}_{name}")
        return self

    @property
    def receipts(self) -> DataFrame:
        return self.spark.table(f"{self.prefix}_receipts")

    @property
    def items(self) -> DataFrame:
        return self.spark.table(f"{self.prefix}_items")

    def lines(self, receipt_id) -> DataFrame:
        """The live lines of a receipt in printed order; one bucket is read."""
        of = self.items.where(F.col("receipt_id") == receipt_id)
        return (of.where("deleted_at = 0") if "deleted_at" in of.columns else of).orderBy("line_no")

    def forget(self) -> None:
        """Takes the tables out of the catalogue; their files stay."""
        for name in ("receipts", "items"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")


def write_log(changes: DataFrame, path: str, block: int = BLOCK, mode: str = "append") -> None:
    """The log in folders of so many revisions each, sorted within, so that a page's revisions name its folders and row
    groups outside of it are skipped. Blocks that several writes share have a file of each."""
    at = F.floor(F.col("rev") / block)
    changes.withColumn("block", at).repartitionByRange("block", "rev").sortWithinPartitions("block", "rev").write.mode(mode).partitionBy("block").parquet(path)


def page(spark: SparkSession, path: str, since: int, rows: int, block: int = BLOCK) -> DataFrame:
    """The next rows of a log that write_log() wrote, whose revisions have no gaps: those after since up to since + rows,
    in order. Only blocks that can hold them are read."""
    log = spark.read.parquet(path)
    some = log.where(F.col("block").between(since // block, (since + rows) // block) & (F.col("rev") > since) & (F.col("rev") <= since + rows))
    return some.drop("block").orderBy("rev")
