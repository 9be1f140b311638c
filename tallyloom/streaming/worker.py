"""A worker that takes jobs of a table in passes, and how long it rests between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.money import backoff_ceiling
from tallyloom.operators import jobs
from tallyloom.sources.versions import Versions

#: Fixed value: an idle worker waits at most so many times its usual interval.
IDLE_MOST = 8


@dataclass
class Idle:
    """The interval to the next pass: the usual one after work, doubling while there is none."""

    interval: float
    empty: int = 0

    def next(self, claimed: int) -> float:
        self.empty = 0 if claimed else self.empty + 1
        return self.interval * min(2 ** max(0, self.empty - 1), IDLE_MOST)


def run_pass(receipts: DataFrame, table: DataFrame, extract: Callable[[DataFrame], DataFrame], now: int, size: int, seed: int = 0) -> DataFrame:
    """table after one pass: receipts without a job get one, due jobs are claimed, extract says what became of each.

    extract takes the claimed jobs and returns (receipt_id, event, error, retryable), event being succeed, skip or
    fail; jobs that it does not answer stay pending. Failed jobs wait a random time below a doubling ceiling. All
    other columns of table stay as they are.
    """
    at = F.lit(now).cast("bigint")
    new = jobs.enqueue(receipts, table).select(
        F.col("id").alias("receipt_id"), "image_id", F.lit("pending").alias("state"), F.lit(0).alias("attempts"),
        at.alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"), at.alias("updated_at"),
    )
    every = table.join(new.select("receipt_id"), "receipt_id", "left_anti").unionByName(new, allowMissingColumns=True)
    claimed = jobs.claim(every, now, size)
    answers = extract(claimed).select(
        "receipt_id", F.col("event").alias("_event"), F.col("error").alias("_error"), F.coalesce("retryable", F.lit(False)).alias("_retryable"),
    )
    done = every.join(answers.join(claimed.select("receipt_id"), "receipt_id", "left_semi"), "receipt_id", "left")
    after = jobs.after(F.col("state"), F.col("attempts"), F.col("_event"), F.col("_retryable"))
    answered = F.col("_event").isNotNull()
    waits = F.floor(F.rand(seed) * backoff_ceiling(F.col("attempts") + 1)).cast("bigint")
    out = done.withColumn("_after", after).withColumns(
        {
            "next_attempt_at": F.when(answered & (F.col("_event") == "fail"), F.lit(now) + waits).otherwise(F.col("next_attempt_at")),
            "last_error": F.when(answered, F.when(F.col("_event") == "fail", F.col("_error"))).otherwise(F.col("last_error")),
            "updated_at": F.when(answered, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
        }
    )
    moved = {c: F.when(answered, F.col(f"_after.{c}")).otherwise(F.col(c)) for c in ("state", "attempts")}
    return out.withColumns(moved).drop("_after", "_event", "_error", "_retryable")


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Jobs by the state a pass moved them to."""
    b = before.select("receipt_id", F.col("updated_at").alias("_then"))
    moved = after.join(b, "receipt_id", "left").where(F.col("_then").isNull() | (F.col("_then") != F.col("updated_at")))
    return moved.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def in_batches(read_receipts: Callable[[], DataFrame], jobs_of: Versions, extract: Callable[[DataFrame], DataFrame], clock: Callable[[], int], size: int = 4) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that runs a pass for each batch of a trigger stream.

    jobs_of holds the table jobs. A pass reads its last version and puts a new one in place behind it, so what a pass
    reads is never overwritten under it, and a pass that dies leaves the table as it was.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table = jobs_of.read("jobs")
        jobs_of.commit((jobs_of.version() or 0) + 1, {"jobs": run_pass(read_receipts(), table, extract, clock(), size, batch_id)})

    return step
