"""Rendezvous sharding: each record goes to the shard whose weighted hash score is best.

The score of record key k on shard j of weight w is -ln(u(k, j)) / w with u from an md5 of both; the smallest score
wins. A further shard only competes for itself, so records move into it and nowhere else, a share of its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, doc_key, md5_uniform

#: Hash ranges that a group's rows are numbered in side by side, of about RANGE_ROWS rows if all rows are in one group.
RANGES, RANGE_ROWS, MOST_RANGES = 256, 4_000_000, 65_536


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """Structs (score, shard), one for each shard."""
    out = []
    for j, w in enumerate(weights):
        u = md5_uniform(F.concat(key, F.lit(f":{j // 2}")), j % 2) + F.lit(0.5 / 2**52)
        out.append(F.struct((-F.log(u) / F.lit(float(w))).alias("score"), F.lit(j).alias("shard")))
    return out


def assign(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a record key: 0 to len(weights) - 1."""
    return F.array_min(F.array(*scores(key, weights)))["shard"]


def numbered(df: DataFrame, group: str, order: Sequence[str], key: str, rows: int, name: str = "slot") -> DataFrame:
    """df, which has so many rows, with the 0-based gapless number of each row in its group, without bringing a group
    to one task.

    Rows of a group are split by a hash of key into ranges, each is numbered by itself, and the counts of the ranges
    before are added. df must give the same rows whenever it is read.
    """
    ranges = min(MOST_RANGES, max(RANGES, rows // RANGE_ROWS))
    df = df.withColumn("_range", (F.conv(F.substring(F.md5(doc_key(F.col(key))), 1, 4), 16, 10).cast("int") % ranges))
    counts = df.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(*order)
    return (
        df.withColumn("_k", F.row_number().over(within) - 1)
        .join(offsets, [group, "_range"])
        .withColumn(name, (F.col("_k") + F.col("_before")).cast("long"))
        .drop("_range", "_k", "_before")
    )


def shard(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text is empty (size 16); a null key counts as the key "null"; rows with equal keys share a shard. No rows
    in give none out. Further columns of docs are not looked at.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    grown = [*weights, sum(weights) / len(weights)]
    text_ = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_) + 16).cast("long").alias("size"),
        F.crc32(text_).cast("long").alias("text_crc32"),
        F.array(*scores(doc_key(F.col(key)), grown)).alias("_scores"),
    ).select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        F.array_min(F.slice("_scores", 1, len(weights)))["shard"].alias("shard"),
        F.array_min("_scores")["shard"].alias("grown_shard"),
    )
    placed = cut(placed, "placed")  # narrow: texts are read and scores computed once
    out = numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "doc_id", placed.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
