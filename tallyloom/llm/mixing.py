"""Mixing sources to target weights by repeating and thinning documents.

Each source's target size gives a repetition rate; a document is taken floor(rate) times plus once more if a hash of
its id under the source's seed falls below the fraction. Of SEEDS seeds each source uses the one whose total comes
nearest its target, so that a few very long documents cannot push a source far off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, doc_key, n_words

#: Weights of the sources in order, repeating; size of the mix over that of the input; most repeats.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEEDS = 16


def draws(key: Column) -> list[Column]:
    """SEEDS numbers in [0, 1) of 32 bits, four from each md5 of the key."""
    out = []
    for k in range(SEEDS):
        digits = F.substring(F.md5(F.concat(F.lit(f"{k // 4}:"), key)), 1 + 8 * (k % 4), 8)
        out.append(F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32)))
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target of each source from (source, source_size), one row for each source.

    Sources in order of code points, null last, take the weights in turn. Shares above most x source_size are held
    there and the rest is shared again by weight: in order of cap / weight, a source is held if the level of those
    not yet held reaches its cap. All windows here run over one row for each source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("_r", "_i").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.col("_all") - F.col("_held")) / (F.col("_weights") - F.col("_held_w"))
    return (
        sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
        .withColumn("weight", w)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_r", F.col("_cap") / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_held", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_held_w", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
        .withColumn("_final", F.min_by("_level", F.when(F.col("_open"), F.struct("_r", "_i"))).over(every))
        .select("source", "source_size", "weight", F.when(F.col("_open"), F.col("weight") * F.col("_final")).otherwise(F.col("_cap")).cast("double").alias("target"))
    )


def _with_rate(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs joined to its source's row. sources is a written table of one row for each source, so Spark broadcasts it
    only below its own size limit and shuffles otherwise."""
    s = sources.select(F.col("source").alias("_source"), *[c for c in sources.columns if c != "source"])
    return docs.join(s, docs["_src"].eqNullSafe(s["_source"]), "left").drop("_source")


def seeds(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, _source_size, _target, _rate, _seed: the plan of each source, from a written table (_id, _src, _size)."""
    by_source = sizes.groupBy("_src").agg(F.sum("_size").alias("source_size")).withColumnRenamed("_src", "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = cut(targets(by_source, weights, share, most).withColumn("_rate", rate), "mix-targets")
    fraction = F.col("_rate") - F.floor("_rate")
    drawn = _with_rate(sizes, sources)
    totals = drawn.groupBy("_src").agg(*[F.sum(F.when(u < fraction, F.col("_size")).otherwise(0)).alias(f"_t{k}") for k, u in enumerate(draws(doc_key(F.col("_id"))))])
    whole = F.floor("_rate") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(whole + F.col(f"_t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    return cut(_with_rate(totals, sources).select(F.col("_src").alias("source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_rate", best.alias("_seed")), "mix-seeds")


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows, which have _id and _src, with their source's plan and _copies: how often each is taken."""
    u = F.element_at(F.array(*draws(doc_key(F.col("_id")))), F.col("_seed") + 1)
    copies = F.floor("_rate") + F.when(u < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return _with_rate(rows, plan).withColumn("_copies", copies.cast("int"))


def _sizes(docs: DataFrame) -> DataFrame:
    return cut(docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), n_words(F.col("text")).alias("_size")), "mix-sizes")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document. Texts are read once.

    Null texts have size 0, a null source is a source of its own and a null id is hashed as "null"; rows with one id
    and source share their draw. An empty table gives no rows.
    """
    sizes = _sizes(docs)
    return _copied(sizes, seeds(sizes)).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as taken() says, with the columns of docs."""
    plan = seeds(_sizes(docs))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"))
    return _copied(rows, plan).withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("row.*")
