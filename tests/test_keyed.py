"""State by key: winners in any order of batches, over restarts, and misses that end by a timer."""

import itertools

from pyspark.sql import functions as F

from tallyloom.operators.replicate import resolve
from tallyloom.streaming import keyed

LOG = "kind string, id long, updated_at long, deleted_at long, rev long, payload string"


def run(out, checkpoint):
    rows = []
    q = out.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows


def plain(df):
    return sorted(map(repr, map(tuple, df.select("kind", "id", "updated_at", "deleted_at", "rev", "payload").collect())))


def test_winners_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    keyed.prepared(spark)
    rows = [("r", i % 5, i * 7 % 11, 0 if i % 3 else i, i, str(i)) for i in range(1, 40)] + [("r", 9, None, 0, 50, None), ("s", 9, 3, 0, 51, None), ("s", 9, 3, 0, 52, "x"), ("s", 9, 3, 0, 49, "x")]
    parts = [rows[:15], rows[15:30], rows[30:]]
    want = plain(resolve(spark.createDataFrame(rows, LOG)))
    for n, order in enumerate(itertools.islice(itertools.permutations(parts), 0, 6, 2)):
        path, check = str(tmp_path / f"log{n}"), str(tmp_path / f"check{n}")
        seen = {}
        for part in order:  # each its own run, so the state goes on from the checkpoint
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(path)
            out = run(keyed.winners(spark.readStream.schema(LOG).parquet(path)), check)
            seen |= {r[:2]: r for r in out}
        assert sorted(map(repr, seen.values())) == want
        assert plain(keyed.held_winners(spark, check)) == want


def test_a_run_without_news_gives_nothing(spark, tmp_path):
    keyed.prepared(spark)
    path, check = str(tmp_path / "log"), str(tmp_path / "check")
    for again in range(2):
        spark.createDataFrame([("r", 1, 5, 0, 1, "a")], LOG).coalesce(1).write.mode("append").parquet(path)
        assert len(run(keyed.winners(spark.readStream.schema(LOG).parquet(path)), check)) == (0 if again else 1)


def test_numbers_are_asked_for_again_once_a_miss_has_ended(spark, tmp_path):
    keyed.prepared(spark)
    path, check = str(tmp_path / "log"), str(tmp_path / "check")
    batches = [
        ([("a", "ask", None, 1), ("a", "ask", None, 1), ("b", "ask", None, 1), (None, "ask", None, 1), ("c", "other", None, 1)], {("a", "lookup", None, 2), ("b", "lookup", None, 1)}),
        ([("a", "ask", None, 1.5), ("b", "found", "B", 1.5)], {("a", "waiting", None, 1)}),
        ([("a", "missing", None, 2), ("a", "ask", None, 20), ("b", "ask", None, 20)], {("a", "miss", None, 1), ("b", "store", "B", 1)}),
        ([("d", "ask", None, 40)], {("d", "lookup", None, 1), ("a", "expired", None, 0)}),
        ([("a", "ask", None, 41), ("d", "ask", None, 43), ("b", "missing", None, 43), ("b", "ask", None, 43)], {("a", "lookup", None, 1), ("d", "lookup", None, 1), ("b", "store", "B", 1)}),
    ]
    for rows, want in batches:
        df = spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "org_number string, event string, company_id string, day double")
        df = df.select("org_number", "event", "company_id", F.timestamp_millis((F.col("day") * keyed.DAY).cast("long")).alias("at"))
        df.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("org_number string, event string, company_id string, at timestamp").parquet(path)
        assert set(run(keyed.numbers(stream), check)) == want
    companies = keyed.held(spark, check, "company").select("key.org_number", "value.company_id").collect()
    assert [tuple(r) for r in companies] == [("b", "B")]
