"""Pushes by stream against a plain sequence; passes and triggers; readings against their contract; files that fail."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import extract, store
from tallyloom.sources import adapter
from tallyloom.sources.versions import Versions
from tallyloom.streaming import feed, worker
from tallyloom.streaming.push import Push

PUSHED = "kind string, id string, seq long, updated_at long, deleted_at long, payload string"
KINDS = ("companies", "receipts", "items")


def plain_push(batches):
    stored, counter, out, log = {}, 0, [], []
    for b, rows in enumerate(batches):
        known = [r for r in rows if r[0] in KINDS]
        out += [(*r[:3], "rejected", 0, "kind", b) for r in rows if r[0] not in KINDS]
        for r in sorted(known, key=lambda r: (KINDS.index(r[0]), r[2])):
            kind, i, seq, updated, deleted, payload = r
            if not i or updated is None:
                out.append((kind, i, seq, "rejected", 0, "meta" if i else "id", b))
                continue
            v = (updated, deleted != 0, payload)
            if (kind, i) in stored and v <= stored[kind, i]:
                out.append((kind, i, seq, "stale", 0, None, b))
                continue
            stored[kind, i] = v
            counter += 1
            out.append((kind, i, seq, "applied", counter, None, b))
            log.append((kind, i, updated, deleted, counter, payload))
    return out, log


def test_pushes_equal_a_plain_sequence(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    batches = [[(rng.choice([*KINDS, "odd"]), rng.choice(["a", "b", "c", "d", ""]), s, rng.choice([1, 2, 3, 4, None]), rng.choice([0, 9]), rng.choice("xyz")) for s in range(40)] for _ in range(3)]
    want, log = plain_push(batches)
    path, kept = str(tmp_path / "in"), Push(spark, str(tmp_path / "s"), 4, KINDS)
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, PUSHED).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(PUSHED).parquet(path)
        if b == 1:
            with monkeypatch.context() as m, pytest.raises(Exception, match="killed"):
                m.setattr(Push, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
                feed.follow(stream, kept, str(tmp_path / "c")).awaitTermination()
        feed.follow(spark.readStream.schema(PUSHED).parquet(path), kept, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(repr, map(tuple, kept.outcomes().select("kind", "id", "seq", "outcome", "rev", "reason", "batch").collect()))) == sorted(map(repr, want))
    assert sorted(map(tuple, kept.log().select("kind", "id", "updated_at", "deleted_at", "rev", "payload").collect()), key=lambda r: r[4]) == log
    last = {(k, i): (u, d, r, p) for k, i, u, d, r, p in log}
    assert {(r["kind"], r["id"]): (r["updated_at"], r["deleted_at"], r["rev"], r["payload"]) for r in kept.read().collect()} == last
    before = kept.outcomes().count()
    kept(spark.createDataFrame(batches[0], PUSHED), 2)
    assert kept.outcomes().count() == before


def test_passes_over_versions_of_the_jobs(spark, tmp_path):
    jobs = "receipt_id long, image_id string, state string, attempts int, next_attempt_at long, last_error string, updated_at long"
    held = Versions(spark, str(tmp_path / "jobs"))
    held.commit(0, {"jobs": spark.createDataFrame([(1, "i1", "pending", 0, 0, None, 0), (2, "i2", "done", 1, 0, None, 0)], jobs)})
    receipts = spark.createDataFrame([(1, "i1", 1), (3, "i3", 2)], "id long, image_id string, rev long")
    answer = lambda claimed: claimed.select("receipt_id", F.when(F.col("receipt_id") == 1, "succeed").otherwise("fail").alias("event"), F.lit("no").alias("error"), F.lit(True).alias("retryable"))
    step = worker.in_batches(lambda: receipts, held, answer, lambda: 100, size=10)
    path = str(tmp_path / "ticks")
    for n in range(2):
        spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r["receipt_id"]: (r["state"], r["attempts"]) for r in held.read("jobs").collect()}
    assert got[1][0] == "done" and got[2][0] == "done" and got[3][0] == "pending" and held.version() >= 2


def test_an_interval_keeps_on_reading(spark, tmp_path):
    schema = "kind string, id long, updated_at long, deleted_at long, rev long, payload string"
    path, latest = str(tmp_path / "log"), feed.Latest(spark, str(tmp_path / "s"), 2)
    write = lambda i: spark.createDataFrame([("r", i, i, 0, i, "x")], schema).coalesce(1).write.mode("append").parquet(path)
    write(1)
    q = feed.follow(feed.read_log(spark, path, spark.createDataFrame([], schema).schema), latest, str(tmp_path / "c"), every="1 second")
    try:
        for i in (2, 3):
            write(i)
            for _ in range(120):
                if latest.version() is not None and latest.read() is not None and latest.read().count() >= i:
                    break
                time.sleep(0.5)
        assert q.isActive and latest.read().count() == 3
    finally:
        q.stop()


def test_malformed_categories_are_left_out(spark):
    rows = [("categories", 1, 0, '{"name": "A", "scope": "both"}'), ("categories", 2, 0, "no json"), ("categories", 3, 7, '{"name": "C"}'), ("tags", 4, 0, '{"name": "D"}'), ("categories", 5, 0, '{"scope": "item"}'), ("categories", 6, 0, None)]
    df = spark.createDataFrame(rows, "kind string, id long, deleted_at long, payload string")
    assert [tuple(r) for r in adapter.categories(df).collect()] == [(1, "A", "both")]


def test_files_that_go_or_are_too_large_have_a_row(spark, tmp_path):
    for name, content in (("a.jpg", b"\xff\xd8\xff\xe0abc"), ("b.png", b"\x89PNG\r\n"), ("c.txt", b"text"), ("d.jpg", b"\xff\xd8\xff" + b"x" * 100), ("e.jpg", b"\xff\xd8\xffgone"), ("f.jpg", b"")):
        (tmp_path / name).write_bytes(content)
    df = store.read_images(spark, str(tmp_path), largest=50)
    (tmp_path / "e.jpg").unlink()
    got = {r["path"].rsplit("/", 1)[1]: (r["mime_type"], r["error"]) for r in df.collect()}
    assert got == {"a.jpg": ("image/jpeg", None), "b.png": ("image/png", None), "c.txt": (None, "not an image"), "d.jpg": (None, "too large"), "e.jpg": (None, "unreadable"), "f.jpg": (None, "unreadable")}


def whole():
    texts = {k: "x" for k, v in extract.CONTRACT.items() if v == extract.TEXT}
    item = dict.fromkeys(extract.CONTRACT["items"][0], "1")
    return texts | {"merchant": dict.fromkeys(extract.CONTRACT["merchant"]), "vatLines": [], "items": [item, item], "confidence": 0.5}


def test_what_departs_from_the_contract_is_told(spark):
    odd = whole() | {"total": 12.5, "extra": 1, "confidence": "high", "vatLines": {"rate": "12"}}
    odd["items"] = [odd["items"][0], {k: v for k, v in odd["items"][1].items() if k != "ean"} | {"name": None, "colour": "red"}, "milk"]
    odd["merchant"] = {k: v for k, v in odd["merchant"].items() if k != "city"}
    del odd["cashier"]
    rows = [(1, json.dumps(whole())), (2, json.dumps(odd)), (3, "nothing"), (4, None), (5, "Sure: " + json.dumps(whole() | {"confidence": None}))]
    got = extract.departures(spark.createDataFrame(rows, "id int, json string")).collect()
    assert sorted((r["id"], r["path"], r["problem"]) for r in got) == [
        (2, "cashier", "missing"), (2, "confidence", "is string"), (2, "extra", "unexpected"), (2, "items[1].colour", "unexpected"), (2, "items[1].ean", "missing"), (2, "items[1].name", "is void"),
        (2, "items[2]", "is string"), (2, "merchant.city", "missing"), (2, "total", "is number"), (2, "vatLines", "is object"), (3, "", "unreadable"), (4, "", "unreadable"),
    ]
    schema = extract.contract()
    assert len(schema.names) == 16 and len(schema["merchant"].dataType.names) == 9 and len(schema["items"].dataType.elementType.names) == 10
    assert spark.createDataFrame([(json.dumps(whole()),)], "j string").select(F.from_json("j", schema)["items"][1]["name"]).first()[0] == "1"


def test_the_merchant_is_read_in_all_its_fields(spark):
    store_ = {"name": "ICA", "orgnr": "165560125790", "momsnr": "5560125790", "street": "Storgatan 1", "zip": "111 22", "ort": "Lund", "country": "SE", "tel": "08-1", "butiksnummer": "7"}
    df = spark.createDataFrame([(1, json.dumps({"store": store_, "payment": "Kort", "kvittonummer": "5", "kassa": "2", "kassör": "-", "sum": "10,50"})), (2, "{}")], "id int, json string")
    r, none = extract.normalize(df, "2026-01-01").orderBy("id").collect()
    assert tuple(r["seller"]) == ("ICA", "556012-5790", "SE556012579001", "Storgatan 1", "111 22", "Lund", "SE", "08-1", "7")
    assert (r["payment_method"], r["receipt_number"], r["terminal_id"], r["cashier"], r["subtotal"]) == ("Kort", "5", "2", None, 10.5)
    assert set(none["seller"]) == {None}


def test_the_first_object_in_one_pass():
    f = extract.first_object
    assert f('x {"a": "}"} {"b": 1}') == '{"a": "}"}' and f("{oops} {\"a\": 1}") == '{"a": 1}' and f('{ {"a": {"b": 2}}') == '{"a": {"b": 2}}'
    assert f("[1]") is None and f(None) is None and f("{") is None and f('{"a": "\\"}"}') == '{"a": "\\"}"}' and f('it"s {"a": 1}') == '{"a": 1}'
    began = time.time()
    assert f("{" * 1_000_000) is None and f("{" * 100_000 + '{"a": 1}') == '{"a": 1}'
    assert time.time() - began < 10
