"""Presence with and without a filter, and plans over tables that are laid out for them."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import presence, store
from tallyloom.sources import layout


def ids(spark, rows, kind="string"):
    return spark.createDataFrame([(r,) for r in rows], f"id {kind}")


@pytest.mark.parametrize(("asked", "stored"), [(range(0, 3000, 3), range(0, 20_000, 2)), (range(5000), range(0, 400, 2)), (range(10), ()), ((), range(10)), ((None, 1, 1, 2), (None, 2, 2))])
@pytest.mark.parametrize("most_bits", [presence.MOST_BITS, 0])
def test_a_filter_changes_no_answer(spark, monkeypatch, asked, stored, most_bits):
    of = presence.Members.of
    monkeypatch.setattr(presence.Members, "of", lambda *a, **k: of(*a, **(k | {"most_bits": most_bits})))
    for kind in ("string", "long"):
        a, s = (ids(spark, [x if x is None or kind == "long" else f"k{x}" for x in xs], kind) for xs in (asked, stored))
        want = sorted(map(tuple, store.status(a.where("id is not null"), s).collect()))
        assert sorted(map(tuple, presence.present(a, s).collect())) == want
        assert sorted(r[0] for r in presence.missing(a, s).collect()) == [i for i, there in want if not there]


def test_the_filter_lets_little_through(spark):
    stored, other = ids(spark, [f"k{i}" for i in range(2000)]), ids(spark, [f"x{i}" for i in range(5000)])
    m = presence.Members.of(stored)
    assert stored.where(m.may_hold(F.col("id"))).count() == 2000
    assert other.where(m.may_hold(F.col("id"))).count() < 150  # about 1 % of what is not there
    assert presence.Members.of(stored, rows=10**9) is None


def test_tables_in_buckets_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        receipts = spark.range(500).select("id", (F.col("id") * 2).cast("decimal(18,2)").alias("total"))
        items = spark.range(3000).select((F.col("id") % 700).alias("receipt_id"), F.col("id").alias("line_no"), F.lit(1).alias("price"), (F.col("id") % 2).alias("deleted_at"))
        t = layout.Together(spark, str(tmp_path / "t"), 8).write(receipts, items)
        joined = t.items.join(t.receipts, F.col("receipt_id") == F.col("id")).groupBy("receipt_id").agg(F.sum("price").alias("n"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, items.join(receipts, items["receipt_id"] == receipts["id"]).groupBy("receipt_id").agg(F.sum("price")).collect()))
        one = t.lines(14)
        assert len({r[0] for r in one.select(F.input_file_name()).collect()}) == 1
        assert [r["line_no"] for r in one.collect()] == [i for i in range(14, 3000, 700) if i % 2 == 0]
        t.forget()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_page_reads_its_blocks_alone(spark, tmp_path):
    log = spark.range(1, 5001).select(F.col("id").alias("rev"), F.lit("x").alias("payload"))
    path = str(tmp_path / "log")
    layout.write_log(log.where("rev <= 4200"), path, 1000)
    layout.write_log(log.where("rev > 4200"), path, 1000)
    some = layout.page(spark, path, 2100, 300, 1000)
    assert [r["rev"] for r in some.collect()] == list(range(2101, 2401))
    assert len({r[0] for r in some.select(F.input_file_name()).collect()}) == 1
    scan = next(line for line in some._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "block" in scan
    assert [r["rev"] for r in layout.page(spark, path, 4990, 50, 1000).collect()] == list(range(4991, 5001))
