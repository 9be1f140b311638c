"""State by key inside a stream: the winning version of each record, and what is known of each organisation number.

State lives in Spark's checkpointed store, so a restart goes on where the last batch ended, and held() reads it from
outside. Rows of a key are taken in one after the other, whatever their number; only the state is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000
#: Fixed value: days for which a number that the registry does not know is not asked for again.
MISS_DAYS = 30

VERSION = "updated_at long, deleted_at long, rev long, payload string"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _whole(x) -> int | None:
    return None if x is None or x != x else int(x)


def rank(version: tuple) -> tuple:
    """What decides between versions (updated_at, deleted_at, rev, payload), as replicate.resolve does: the later, the
    deleted one, the larger content, the smaller revision; nulls before all else."""
    updated, deleted, rev, payload = version
    return updated is not None, updated or 0, deleted is not None, deleted not in (None, 0), payload is not None, payload or "", rev is not None, -(rev or 0)


class Winner(StatefulProcessor):
    """Value state: the version of a record that has won so far. Gives a row for each record whose winner changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("winner", VERSION)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.best.get() if self.best.exists() else None
        best = before = None if before is None else tuple(before)
        for df in rows:
            for updated, deleted, rev, payload in zip(df["updated_at"], df["deleted_at"], df["rev"], df["payload"], strict=True):
                version = (_whole(updated), _whole(deleted), _whole(rev), payload if isinstance(payload, str) else None)
                if best is None or rank(version) > rank(best):
                    best = version
        if best != before:
            self.best.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["kind", "id", "updated_at", "deleted_at", "rev", "payload"])

    def close(self) -> None:
        pass


def winners(changes: DataFrame) -> DataFrame:
    """changes (kind, id, updated_at, deleted_at, rev, payload) as a stream of winners, one row each time a record's
    winner changes; the last row of a record is what replicate.resolve gives for all changes so far, in whatever order
    and batches they come. A batch DataFrame gives each winner once."""
    kinds = ", ".join(f"{c} {changes.schema[c].dataType.simpleString()}" for c in ("kind", "id"))
    wanted = changes.select("kind", "id", "updated_at", "deleted_at", "rev", "payload")
    return wanted.groupBy("kind", "id").transformWithStateInPandas(Winner(), f"{kinds}, {VERSION}", "Update", "None")


class Numbers(StatefulProcessor):
    """What is known of an organisation number.

    Value state: the company that was found, for good. Map state: by event missing or lookup, the time of the last one.
    Timers in the stream's time remove a miss after days, which the row expired tells of, and a lookup after patience,
    so numbers that nobody asks for any more leave no state but their company.
    """

    def __init__(self, days: int = MISS_DAYS, patience: int = DAY) -> None:
        self.days, self.patience = days, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.company = handle.getValueState("company", "company_id string")
        self.known = handle.getMapState("known", "event string", "at long")

    def _time(self, event: str) -> int | None:
        return self.known.getValue((event,))[0] if self.known.containsKey((event,)) else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asks, last, missing, company = 0, None, None, None
        for df in rows:
            at = df["at"].astype("int64") // 1000 if str(df["at"].dtype) == "datetime64[us]" else df["at"].astype("datetime64[ms]").astype("int64")
            asked, absent, found = (at[df["event"] == e] for e in ("ask", "missing", "found"))
            asks += len(asked)
            last = max([x for x in (last, asked.max() if len(asked) else None) if x is not None], default=None)
            missing = max([x for x in (missing, absent.max() if len(absent) else None) if x is not None], default=None)
            if len(found):
                here = (int(found.max()), str(df["company_id"][found[found == found.max()].index].min()))
                company = max(company or here, here)
        if company is not None:
            self.company.update((company[1],))
            self.known.removeKey(("missing",))
        elif missing is not None and not self.company.exists() and int(missing) > (self._time("missing") or -1):
            self.known.updateValue(("missing",), (int(missing),))
            self.handle.registerTimer(int(missing) + self.days * DAY)
        if not asks:
            return
        absent, sought = self._time("missing"), self._time("lookup")
        if self.company.exists():
            step, name = "store", self.company.get()[0]
        else:
            name = None
            if absent is not None and absent > last - self.days * DAY:
                step = "miss"
            elif sought is not None and sought > last - self.patience and (absent is None or sought > absent):
                step = "waiting"
            else:
                step = "lookup"
                self.known.updateValue(("lookup",), (int(last),))
                self.handle.registerTimer(int(last) + self.patience)
        yield pd.DataFrame([(*key, step, name, asks)], columns=["org_number", "step", "company_id", "asks"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        absent, sought, now = self._time("missing"), self._time("lookup"), expiredTimerInfo.getExpiryTimeInMs()
        if sought is not None and sought + self.patience <= now:
            self.known.removeKey(("lookup",))
        if absent is not None and absent + self.days * DAY <= now:  # not one that came since
            self.known.removeKey(("missing",))
            yield pd.DataFrame([(*key, "expired", None, 0)], columns=["org_number", "step", "company_id", "asks"])

    def close(self) -> None:
        pass


def numbers(events: DataFrame, days: int = MISS_DAYS, late: str = "0 seconds") -> DataFrame:
    """(org_number, step, company_id, asks): what a stream of events decides for each number and batch.

    events (org_number, event, company_id, at): ask, or the registry's answer, found with a company or missing. A number
    is store once it was found, miss for days after it was missing, waiting while a lookup of the last day has no
    answer, and else lookup; expired tells that a miss has ended. asks counts the questions of the batch, which is
    answered once for all of them. A batch's answers come ahead of its questions; other events, and numbers that are
    null, are left out. at is a timestamp; an event no later than the stream's time, late behind the latest event of the
    batches before, comes too late and is dropped.
    """
    some = events.where(F.col("event").isin("ask", "found", "missing") & F.col("org_number").isNotNull() & F.col("at").isNotNull())
    wanted = some.select("org_number", "event", "company_id", "at").withWatermark("at", late)
    return wanted.groupBy("org_number").transformWithStateInPandas(Numbers(days), "org_number string, step string, company_id string, asks long", "Update", "EventTime")


def held(spark: SparkSession, checkpoint: str, state: str, **options: str) -> DataFrame:
    """What a stream's checkpoint holds in a state variable, such as winner: key and value columns."""
    rows = prepared(spark).read.format("statestore").option("stateVarName", state).options(**options).load(checkpoint)
    return rows.drop("partition_id")


def held_winners(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The winner of each record as the checkpoint of winners() has it."""
    return held(spark, checkpoint, "winner").select("key.*", "value.*")
