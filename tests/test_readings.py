"""Which object of a reading is taken, and what it costs to hold it against the contract."""

import json

from pyspark.sql import functions as F

from tallyloom.operators import extract
from tallyloom.plans import streams
from tallyloom.sources.adapter import Domain

ODD = [
    None, "", "{", "}", "}{", "{} {}", "[{}]", 'x {"a": "}"} y', '{oops} {"a": 1}', '{ {"a": {"b": 2}}', 'it"s {"a": 1}', '{"a": 1}}', '{"a": 1, "a": 2}', '{"a": NaN}',
    '```json\n{"a": 1}\n``` {x}', '{"a": "\\"}"}', "{" * 5000 + "}" * 5000, '{"a": ' * 1200 + "1", "[1]", '\U0001f600 {"å": "\U0001f600"} \U0001f600',
]


def test_the_object_is_that_of_the_search(spark):
    df = extract.parsed(spark.createDataFrame(list(enumerate(ODD)), "id int, json string"), "v").select("id", F.to_json("v").alias("v"))
    want = spark.createDataFrame([(i, extract.first_object(t)) for i, t in enumerate(ODD)], "id int, o string").select("id", F.to_json(F.try_parse_json("o")).alias("v"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_departures_at_any_depth(spark):
    reading = {n: None for n, kinds in extract.CONTRACT.items() if kinds == extract.TEXT} | {"confidence": None, "vatLines": {}, "merchant": [], "total": {"a": 1}, "a:b": 1}
    item = {n: None for n in extract.CONTRACT["items"][0]} | {"totalPrice": 1.5, "unit": [1], "x.y": None}
    del item["ean"]
    df = spark.createDataFrame([(1, json.dumps(reading | {"items": [item, None, 3]}))], "id int, json string")
    assert sorted((r["path"], r["problem"]) for r in extract.departures(df).collect()) == [
        ("a:b", "unexpected"), ("items[0].ean", "missing"), ("items[0].name", "is void"), ("items[0].totalPrice", "is number"), ("items[0].unit", "is array"),
        ("items[0].x.y", "unexpected"), ("items[1]", "is void"), ("items[2]", "is number"), ("merchant", "is array"), ("total", "is object"), ("vatLines", "is object"),
    ]


def test_readings_of_a_small_table_are_shared_among_tasks(spark, sf_dir):
    assert streams.contract_departures(Domain(spark, sf_dir)).select(F.spark_partition_id()).distinct().count() > 4
