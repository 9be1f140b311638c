"""A corpus pipeline of five stages; each takes what the one before kept and returns it changed or thinned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, packing, secrets, simhash, toxicity
from tallyloom.llm.common import cut, drop

TOXIC_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_AT stay. The model learns from labelled documents outside the held-out fold.

    A null text scores like an empty one and stays as it is; repeated rows and rows without an id are scored each for
    itself, so equal texts go or stay together. Without labels of both kinds nothing goes unless all are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model).where(F.col("score") < TOXIC_AT).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are 0.8 alike or more the one with the smallest id stays.

    Rows without an id come after all others, and ties go to the smaller hash of the text. Null, empty and blank texts
    have no shingles and are alike; rows equal in id and text count as one.
    """
    return simhash.kept(docs, shingle=5, similarity=0.8)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the secrets in its text replaced by a mark and n_chars counted again.

    A null text stays null and has a null n_chars; repeated rows and rows without an id are kept as they are.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for.

    A null source is a source of its own; rows with one id and source are taken equally often, rows without an id count
    as one id. A source without words has the rate 0 and drops out.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its place in a training sequence.

    A null text is empty and has its end id alone; every row is packed for itself, whatever it repeats.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression lengths, fingerprints and token ids have no SQL form; a test holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)  # nothing reads an earlier stage any more
    return STAGES[-1][1](spark, docs, sf_dir)
