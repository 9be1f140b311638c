"""Pushes of records taken in from a stream: each row is rejected, stale or applied, and applied ones get revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.replicate import KINDS, rejected, resolve, revisions
from tallyloom.streaming.feed import Latest

LOG = ["kind", "id", "updated_at", "deleted_at", "rev", "payload"]


def _weight(alias: str = "") -> Column:
    """A version as it is weighed against others."""
    c = lambda n: F.col(f"{alias}{n}")
    return F.struct(c("updated_at").alias("u"), (c("deleted_at") != 0).alias("d"), c("payload").alias("p"))


class Push(Latest):
    """Takes pushes (kind, id, seq, updated_at, deleted_at, payload, and value for secrets) batch by batch.

    Rows of a batch count in the order of kinds and of seq, each against what is stored and what came ahead of it: only
    a version that beats all of them is applied, a tie keeps what is there. Applied rows get gapless revisions after
    those given before. The state, the log, the outcomes and the revision counter of a batch are put in place at once,
    so a batch that died on the way, or comes again, counts once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, kinds: Sequence[str] = KINDS, secrets: Sequence[str] = ()) -> None:
        super().__init__(spark, path, buckets)
        self.kinds, self.secrets = kinds, secrets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last = self.version()
        if last is not None and last >= batch_id:
            return
        made = self.manifest(last)
        buckets, counter = made.notes.get("buckets", self.first_buckets), made.notes.get("counter", 0)
        value = F.col("value") if "value" in batch.columns else None
        reason = rejected(F.col("kind"), F.col("id"), F.col("updated_at"), F.col("deleted_at"), F.col("payload"), self.kinds, self.secrets, value)
        judged = batch.withColumn("reason", reason).persist()
        try:
            sound = judged.where("reason IS NULL")
            touched = [r[0] for r in sound.select(self.bucket(buckets)).distinct().collect()]  # at most one a bucket
            stored = self.read(touched) if touched else None
            rows = sound.select(*[c for c in LOG if c != "rev"], "seq")
            if stored is not None:
                rows = rows.join(stored.select("kind", "id", _weight().alias("_there")), ["kind", "id"], "left")
            else:
                rows = rows.withColumn("_there", F.lit(None).cast("struct<u:long,d:boolean,p:string>"))
            before = Window.partitionBy("kind", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
            held = F.greatest("_there", F.max(_weight()).over(before))  # greatest passes over nulls
            rows = rows.withColumn("outcome", F.when(held.isNull() | (_weight() > held), "applied").otherwise("stale")).drop("_there")
            applied = revisions(rows.where("outcome = 'applied'"), counter, "seq", self.kinds).withColumnRenamed("new_rev", "rev").persist()
            try:
                n = applied.count()
                outcomes = (
                    applied.select("kind", "id", "seq", "outcome", "rev", F.lit(None).cast("string").alias("reason"))
                    .unionByName(rows.where("outcome = 'stale'").select("kind", "id", "seq", "outcome", F.lit(0).cast("long").alias("rev"), F.lit(None).cast("string").alias("reason")))
                    .unionByName(judged.where("reason IS NOT NULL").select("kind", "id", "seq", F.lit("rejected").alias("outcome"), F.lit(0).cast("long").alias("rev"), "reason"))
                    .withColumn("batch", F.lit(batch_id).cast("long"))
                )
                made.notes = made.notes | {"buckets": buckets, "counter": counter + n, "rows": made.notes.get("rows", 0) + n}
                made = self._difference(self._difference(made, "outcomes", outcomes), "log", applied.select(*LOG))
                if n:
                    winners = resolve(applied.select(*LOG))
                    hit = sorted(r[0] for r in winners.select(self.bucket(buckets)).distinct().collect())
                    made = self._added(made, winners.select(*LOG), hit, buckets)
            finally:
                applied.unpersist()
        finally:
            judged.unpersist()
        self.publish(batch_id, made)

    def outcomes(self) -> DataFrame | None:
        """(kind, id, seq, outcome, rev, reason, batch) of every row so far; rev is 0 but for applied ones."""
        return self.derived("outcomes")

    def log(self) -> DataFrame | None:
        """Every version that was applied, with its revision: what readers pull."""
        return self.derived("log")
