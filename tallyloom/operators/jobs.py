"""A table of extraction jobs and its transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.money import backoff_ceiling

STATES = ("pending", "running", "done", "failed", "skipped")
ATTEMPTS = 3


def eligible(receipts: DataFrame, extracted: DataFrame) -> DataFrame:
    """Live receipts with an image that are neither confirmed nor extracted."""
    return receipts.where("deleted_at = 0 and image_id is not null and status <> 'confirmed'").join(extracted.select("id"), "id", "left_anti")


def enqueue(receipts: DataFrame, jobs: DataFrame, most: int | None = None) -> DataFrame:
    """Receipts without a job or with another image than their job's, by revision; filtered before they are cut off."""
    j = jobs.select(F.col("receipt_id").alias("id"), F.col("image_id").alias("_image"))
    out = receipts.join(j, "id", "left").where("_image is null or _image <> image_id").drop("_image")
    return out.orderBy("rev", "id").limit(most) if most else out


def claim(jobs: DataFrame, now: int, most: int) -> DataFrame:
    """Due jobs, those waiting longest first."""
    return jobs.where((F.col("state") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "receipt_id").limit(most)


def counts(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs in each state, none included, and how many of them wait for a later time."""
    waiting = F.sum(((F.col("state") == "pending") & (F.col("next_attempt_at") > now)).cast("int"))
    found = jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n"), waiting.cast("bigint").alias("waiting"))
    states = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(found, "state", "left").fillna(0, ["n", "waiting"])


def recent_failures(jobs: DataFrame, most: int = 5) -> DataFrame:
    return jobs.where("last_error is not null and state in ('failed', 'pending')").orderBy(F.col("updated_at").desc(), "receipt_id").limit(most)


def after(state: Column, attempts: Column, event: Column, retryable: Column) -> Column:
    """Struct (state, attempts) after an event: succeed, skip, fail or requeue."""
    tried = attempts + 1
    done = (~retryable) | (tried >= ATTEMPTS)
    return (
        F.when(event == "succeed", F.struct(F.lit("done").alias("state"), attempts.alias("attempts")))
        .when(event == "skip", F.struct(F.lit("skipped").alias("state"), attempts.alias("attempts")))
        .when(event == "requeue", F.struct(F.lit("pending").alias("state"), F.lit(0).alias("attempts")))
        .when(event == "fail", F.struct(F.when(done, "failed").otherwise("pending").alias("state"), tried.alias("attempts")))
        .otherwise(F.struct(state.alias("state"), attempts.alias("attempts")))
    )


def retry_at(now: Column, attempts: Column, seed: int) -> Column:
    """When a failed job is due again: a random time below the doubling ceiling."""
    return (now + F.floor(F.rand(seed) * backoff_ceiling(attempts))).cast("bigint")


def search_budget(asked: DataFrame, per_day: int = 8, day: str = "day", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The searches of each day that its budget allows, earliest first."""
    from pyspark.sql import Window

    return asked.withColumn("_r", F.row_number().over(Window.partitionBy(day).orderBy(*order))).where(F.col("_r") <= per_day).drop("_r")
