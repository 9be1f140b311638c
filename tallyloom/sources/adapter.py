"""The domain's tables, read from the driver's star schema; column pruning and filters reach the Parquet scans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order status to receipt status.
STATUS = {"F": "confirmed", "O": "parsed", "P": "failed"}


@dataclass
class Domain:
    """Receipts, items, tags, changes and what derives from them, over the tables in sf_dir."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def receipts(self) -> DataFrame:
        # Keys made distinct let Catalyst drop a left join whose columns nobody asks for.
        orders, customer, nation = self.table("orders"), self.table("customer").dropDuplicates(["c_custkey"]), self.table("nation").dropDuplicates(["n_nationkey"])
        status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
        return (
            orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
            .join(nation, F.col("c_nationkey") == nation["n_nationkey"], "left")
            .select(
                F.col("o_orderkey").alias("id"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("purchased_at"),
                F.col("o_orderdate").alias("purchased_on"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
                status[F.col("o_orderstatus")].alias("status"),
                F.col("c_name").alias("merchant"),
                F.col("n_name").alias("city"),
                F.col("o_orderpriority").alias("category_id"),
                F.col("o_custkey").alias("company_id"),
                F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0).cast("bigint").alias("deleted_at"),
                (F.col("o_orderkey") * 10 + F.col("o_custkey") % 7).alias("updated_at"),
                F.when(F.col("o_orderkey") % 9 == 0, F.array(F.lit("total-mismatch"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
                F.sha2(F.col("o_orderkey").cast("string"), 256).alias("image_id"),
            )
        )

    @cached_property
    def live(self) -> DataFrame:
        return self.receipts.where("deleted_at = 0")

    @cached_property
    def items(self) -> DataFrame:
        line, part = self.table("lineitem"), self.table("part").dropDuplicates(["p_partkey"])
        price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
        return line.join(part, line["l_partkey"] == part["p_partkey"], "left").select(
            F.col("l_orderkey").alias("receipt_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("part_id"),
            F.col("p_name").alias("name"),
            F.col("p_name").alias("search_name"),
            F.col("p_type").alias("category_id"),
            F.col("p_brand").alias("brand"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_tax") * 100).alias("vat_rate"),
            price.cast("decimal(18,4)").alias("total_price"),
            (F.col("l_returnflag") == "R").alias("is_discount"),
            ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("is_deposit"),
        )

    @cached_property
    def receipt_tags(self) -> DataFrame:
        return self.items.select("receipt_id", F.col("brand").alias("tag_id")).distinct()

    @cached_property
    def changes(self) -> DataFrame:
        events = self.table("events")
        updated = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
        return events.select(
            F.col("event_type").alias("kind"), F.col("user_id").alias("id"), updated.alias("updated_at"),
            F.when(F.col("value") < 1, updated).otherwise(0).alias("deleted_at"), (F.col("event_id") + 1).alias("rev"), F.col("props").alias("payload"), "value",
        )

    @cached_property
    def blobs(self) -> DataFrame:
        """Stored images: one for each document text, by content."""
        d = self.table("documents")
        return d.select("doc_id", F.sha2("text", 256).alias("id"), F.octet_length("text").cast("bigint").alias("byte_size"))


def live(df: DataFrame) -> DataFrame:
    """Rows that are not tombstoned."""
    return df.where("deleted_at = 0")


def decode(changes: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Change rows with their payload parsed; rows whose payload is malformed are left out."""
    parsed = changes.withColumn("record", F.from_json(payload, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("record is not null and record._corrupt is null").withColumn("record", F.col("record").dropFields("_corrupt"))


def read_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Line-delimited JSON as rows of schema, at once or as a stream. A line that is no JSON has its text in _corrupt
    and nulls elsewhere; empty lines are left out, and a last line without an end counts."""
    reader = (spark.readStream if stream else spark.read).schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def categories(changes: DataFrame) -> DataFrame:
    """(id, name, scope) of live categories in a change log; rows whose payload is malformed are left out."""
    found = decode(changes.where("kind = 'categories' and deleted_at = 0"), "name string, scope string")
    return found.where("record.name is not null").select("id", "record.name", "record.scope")
