"""The registry's files as a data source: ranges, filters, commits and aborts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import registry


def number(i):
    first = f"{556000000 + i}"
    s = sum(d - 9 if d > 9 else d for d in (int(c) * (2 - k % 2) for k, c in enumerate(first)))
    return f"{first[:6]}-{first[6:]}{-s % 10}"


def answer(i, **more):
    return json.dumps({"org_number": number(i), "name": f"Bolag {i} AB", "active": i % 3 > 0, "sni_codes": [{"description": f"b{i}"}], "city": "Åmål"} | more)


def answers(spark, rows):
    return spark.createDataFrame([(number(i), a) for i, a in rows], "number string, raw string")


@pytest.fixture()
def path(spark, tmp_path):
    registry.register(spark)
    registry.store(answers(spark, [(i, answer(i)) for i in range(400)]), str(tmp_path / "store"), files=8)
    return str(tmp_path / "store")


def read(spark, path):
    return spark.read.format("registry").load(path)


def test_rows_come_back_flat(spark, path):
    r = read(spark, path).where(F.col("number") == number(7)).first()
    assert (r["name"], r["active"], r["industry"], r["city"], r["address"]) == ("Bolag 7 AB", True, "b7", "Åmål", None)
    assert json.loads(r["raw"]) == json.loads(answer(7)) and read(spark, path).count() == 400


def test_one_number_reads_one_file(spark, path):
    df = registry.lookup(read(spark, path), "16" + number(123).replace("-", ""))
    assert [r["id"] for r in df.collect()] == [number(123).replace("-", "")]
    assert df.rdd.getNumPartitions() == 1
    assert read(spark, path).rdd.getNumPartitions() == 8
    some = read(spark, path).where(F.col("number").between(number(100), number(140)) & (F.col("name") != "x"))
    assert some.count() == 41 and some.rdd.getNumPartitions() <= 2
    assert read(spark, path).where(F.col("number").isin(number(1), number(399))).count() == 2
    assert read(spark, path).where((F.col("number") == number(5)) & F.col("active")).count() == 1
    assert registry.lookup(read(spark, path), "12").count() == 0


def test_an_aborted_write_leaves_nothing(spark, path):
    before = sorted(os.listdir(path))

    @F.udf("string")
    def fails(x):
        if x == number(900):
            raise ValueError("no")
        return answer(5000)

    bad = spark.createDataFrame([(number(i),) for i in range(800, 950)], "number string").withColumn("raw", fails("number"))
    with pytest.raises(Exception, match="no"):
        registry.store(bad, path, files=4)
    assert sorted(os.listdir(path)) == before and read(spark, path).count() == 400


def test_append_and_overwrite(spark, path):
    registry.store(answers(spark, [(i, answer(i)) for i in range(1000, 1010)]), path, files=2)
    assert read(spark, path).count() == 410
    registry.store(answers(spark, [(1, answer(1)), (2, "no json"), (3, None), (4, '{"name": "x"}')]), path, mode="overwrite")
    assert [r["number"] for r in read(spark, path).collect()] == [number(1)]
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1


def test_an_empty_store_and_a_foreign_path(spark, tmp_path):
    registry.register(spark)
    assert read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="mounted"):
        read(spark, "hdfs://far/store").count()


def test_search_keeps_the_order_and_drops_what_has_no_number(spark, path):
    odd = spark.createDataFrame([("000000-0000", "Bolag odd", "{}"), ("556000-0001", "", "{}"), ("559999-0000", "Ett Bolag", "{}")], "number string, name string, raw string")
    every = read(spark, path).select("number", "name", "raw").unionByName(odd)
    hits = registry.search(every, " BOLAG ")
    assert [r["number"] for r in hits.collect()] == [number(i) for i in range(9)]  # the tenth hit has no number that holds
    assert registry.search(every, "bo").count() == 0


def test_stored_companies(spark):
    df = spark.createDataFrame([("5560125790", "A", 0), ("5560360793", "B", 9)], "id string, name string, deleted_at long")
    assert [r["name"] for r in registry.companies(df).collect()] == ["A"]
    got = [[r["name"] for r in registry.company(df, n).collect()] for n in ("556012-5790", "165560125790", "556036-0793", "12", "")]
    assert got == [["A"], ["A"], [], [], []]
