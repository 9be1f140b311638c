"""Places and runs along an order against plain loops, in few and many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import filters, replicate, rollups
from tallyloom.operators.order import islands, placed


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_places_and_runs(spark, ranges):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b"]) if i % 17 else "c", rng.choice([0, 0, 0, 5, 10**12, rng.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v long").withColumn("_x", F.lit(1)).repartition(5)
    order = [F.col("v").desc(), F.col("id").asc()]
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["id"]: r["place"] for r in placed(df, order, ranges=ranges).collect()} == {r[0]: i for i, r in enumerate(want, 1)}
    run, out = 0, {}
    for i, r in enumerate(want):
        run += i == 0 or r[1] != want[i - 1][1]
        out[r[0]] = run
    got = islands(df, order, "k", ranges=ranges)
    assert got.columns == ["id", "k", "v", "_x", "island"] and {r["id"]: r["island"] for r in got.collect()} == out


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, k string")
    assert placed(df, [F.col("id").asc()]).count() == 0 and islands(df, [F.col("id").asc()], "k").count() == 0


def test_revisions_of_a_bunched_order(spark):
    rows = [("items" if i % 4 else "receipts", i % 3 + (10**15 if i == 7 else 0) + i / 1000, i) for i in range(200)] + [("odd", 1.0, 999)]
    df = spark.createDataFrame(rows, "kind string, seq double, id long")
    got = {r["id"]: r["new_rev"] for r in replicate.revisions(df, 50, "seq", ranges=6).collect()}
    want = sorted(rows, key=lambda r: (["receipts", "items", "odd"].index(r[0]), r[1]))
    assert got == {r[2]: 51 + i for i, r in enumerate(want)}


def test_sections_by_merchant(spark):
    rows = [(1, "B", "2024-01-03", "parsed"), (2, "A", "2024-02-01", "failed"), (3, "A", "2024-01-09", "failed"), (4, "Å", None, "parsed"), (5, "Z", "2024-01-01", "parsed"), (6, None, None, "failed")]
    df = spark.createDataFrame(rows, "id long, merchant string, purchased_at string, status string").withColumn("warnings", F.array().cast("array<string>"))
    got = rollups.sections(df, filters.receipt_order("merchant", False), filters.needs_review(F.col("status"), F.col("warnings"))).orderBy("section", "id").collect()
    # in order: nobody, A, A, B, Z, Å
    assert [(r["id"], r["month"], r["section"], r["to_review"]) for r in got] == [
        (6, "okänt", 1, 1), (2, "2024-02", 2, 1), (1, "2024-01", 3, 1), (3, "2024-01", 3, 1), (5, "2024-01", 3, 1), (4, "okänt", 4, 1),
    ]
