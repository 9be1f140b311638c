"""Tables behind one manifest: all old or all new; categories by an automaton against the plain rule."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import categories, records
from tallyloom.sources.versions import Versions

RECEIPTS = "id string, city string, currency string, merchant struct<name:string,org_number:string>, status string, updated_at long, dirty int, item_count int"
ITEMS = "id string, receipt_id string, line_no int, name string, search_name string, category_id string, total_price decimal(18,2), deleted_at long, updated_at long, dirty int"
READING = "id string, city string, currency string, merchant struct<name:string,org_number:string>, items array<struct<name:string,total_price:decimal(18,2)>>"


@pytest.fixture()
def held(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    receipts = [("a", "Lund", "EUR", ("x", "1"), "draft", 1, 0, 2), ("b", "Ystad", None, None, "failed", 1, 0, 7), ("c", None, "SEK", None, "draft", 1, 0, 1)]
    items = [("i1", "a", 0, "gammal", "gammal", None, None, 0, 1, 0), ("i2", "a", 1, "borta", "borta", None, None, 5, 1, 0), ("i3", "c", 0, "kvar", "kvar", None, None, 0, 1, 0)]
    v.commit(0, {"receipts": spark.createDataFrame(receipts, RECEIPTS), "items": spark.createDataFrame(items, ITEMS), "links": spark.range(3)})
    return v


def readings(spark):
    from decimal import Decimal

    rows = [("a", None, None, ("y", None), [("Mellanmjölk 3%", Decimal("12.50")), ("Zzz", None)]), ("b", "Malmö", "SEK", ("z", "2"), None), ("nobody", "x", "x", None, [("Ost", None)])]
    return spark.createDataFrame(rows, READING)


def state(v):
    heads = {r["id"]: (r["city"], r["currency"], r["merchant"] and tuple(r["merchant"]), r["status"], r["updated_at"], r["dirty"], r["item_count"]) for r in v.read("receipts").collect()}
    lines = sorted((r["receipt_id"], r["line_no"], r["name"], r["search_name"], r["category_id"], r["deleted_at"], r["dirty"]) for r in v.read("items").na.fill("-").collect())
    return heads, lines


def test_a_reading_changes_receipts_and_items_together(spark, held):
    records.commit_extraction(held, 1, readings(spark), ("city",), 9, replaced=("currency",), merchant=("name", "org_number"))
    heads, lines = state(held)
    assert heads == {
        "a": ("Lund", None, ("y", "1"), "parsed", 9, 1, 2), "b": ("Malmö", "SEK", ("z", "2"), "parsed", 9, 1, 0), "c": (None, "SEK", None, "draft", 1, 0, 1),
    }
    assert lines == [
        ("a", 0, "Mellanmjölk 3%", "mellanmjölk 3", "seed-category-mejeri", 0, 1), ("a", 0, "gammal", "gammal", "-", 9, 1), ("a", 1, "Zzz", "zzz", "-", 0, 1), ("a", 1, "borta", "borta", "-", 5, 0), ("c", 0, "kvar", "kvar", "-", 0, 0),
    ]
    assert len({r[0] for r in held.read("items").select("id").collect()}) == 5 and held.read("links").count() == 3


@pytest.mark.parametrize("dies_at", ["second table", "manifest"])
def test_a_death_on_the_way_leaves_all_as_it_was(spark, held, monkeypatch, dies_at):
    before, write, calls = state(held), Versions.write, []

    def once(self, name, df, partition=None):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("killed")
        return write(self, name, df, partition)

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Versions, *(("write", once) if dies_at == "second table" else ("publish", dies)))
        records.commit_extraction(held, 1, readings(spark), ("city",), 9)
    again = Versions(spark, held.path)
    assert again.version() == 0 and state(again) == before
    records.commit_extraction(again, 1, readings(spark), ("city",), 9)
    assert state(again)[0]["b"][3] == "parsed"
    records.commit_extraction(again, 2, readings(spark), ("city",), 10)
    assert len(again.versions()) == 2 and sum(n.startswith("data-") for n in again._names()) == 5  # nothing is left of what died
    with pytest.raises(ValueError):
        again.commit(2, {})


def test_a_version_can_be_read_while_the_next_is_made(spark, held):
    was = held.manifest(0)
    held.commit(1, {"links": spark.range(8)})
    assert held.manifest(0) == was and held.read("links", version=0).count() == 3 and held.read("links").count() == 8
    assert held.read("nothing") is None and Versions(spark, held.path + "/none").version() is None


def test_a_large_dictionary_by_automaton(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdeåö ") for _ in range(n))
    words = [(word(rng.randrange(1, 12)), f"s{i}", i // 3) for i in range(100_000)]
    words = list({w: (w, s, p) for w, s, p in words}.values())  # a word has one slug, so that ties are told by position
    by = {w: (len(w), -p, s) for w, s, p in words}
    names = [word(rng.randrange(0, 80)) for _ in range(150)] + ["krossade tomater", None, ""]
    want = []
    for i, n in enumerate(names):
        n = n or ""
        hits = [by[n[a:b]] for a in range(len(n)) for b in range(a + 1, min(len(n), a + 12) + 1) if n[a:b] in by]
        want.append((i, max(hits)[:2] if hits else None))
    df = spark.createDataFrame(list(enumerate(names)), "id int, search_name string")
    table = spark.createDataFrame([*words, ("", "none", 0), (None, "none", 0)], "word string, slug string, position int").repartition(4)
    of = {s: (n, p) for n, p, s in by.values()}
    for pass_bytes in (categories.PASS_BYTES, 500_000):
        got = {r["id"]: r["slug"] for r in categories.guess_in(df, table, pass_bytes=pass_bytes).collect()}
        assert [(i, of.get(got[i])) for i in range(len(names))] == want


def test_the_automaton_and_the_plain_words_agree(spark):
    table = spark.createDataFrame([(w, s, i) for i, (w, s) in enumerate((w, s) for s, ws in categories.WORDS.items() for w in ws)], "word string, slug string, position int")
    names = ["krossade tomater", "mellanmjölk", "ostkaka", "te", "pantglass", "crème fraîche 34", "zzz", "kaffe te", "falukorv skinka"]
    df = spark.createDataFrame([(n,) for n in names], "search_name string")
    got = categories.guess_in(df, table).withColumn("plain", categories.guess(F.col("search_name"))).collect()
    assert [r["slug"] for r in got] == [r["plain"] for r in got] and {r["search_name"]: r["slug"] for r in got}["krossade tomater"] == "skafferi"
    assert categories.guess_in(df, table.limit(0)).where("slug is not null").count() == 0
