"""Small tables with every edge that the operators define."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import filters, jobs, quality, replicate, rollups, store, vision
from tallyloom.operators.filters import PurchaseFilter, ReceiptFilter
from tallyloom.sources.adapter import decode

RECEIPTS = "id long, merchant string, city string, purchased_at string, total decimal(18,2), status string, category_id string, warnings array<string>, deleted_at long, updated_at long"
ITEMS = "receipt_id long, line_no int, part_id long, name string, search_name string, category_id string, quantity double, total_price decimal(18,4), is_discount boolean, is_deposit boolean"


@pytest.fixture(scope="module")
def receipts(spark):
    from decimal import Decimal as D

    return spark.createDataFrame(
        [
            (1, "ICA", "Lund", "2024-03-01", D("10.00"), "parsed", "a", [], 0, 5),
            (2, None, None, None, None, "draft", None, ["x"], 0, 9),
            (3, "Coop", "Malmö", "2024-03-31T10:00:00", D("-5.00"), "failed", "b", [], 0, 7),
            (4, "ICA", "Lund", "2024-02-10", D("7.50"), "confirmed", "a", ["x"], 1, 1),
            (5, "ICA", "Lund", None, D("0.00"), "parsed", "a", None, 0, 11),
        ],
        RECEIPTS,
    )


@pytest.fixture(scope="module")
def items(spark):
    from decimal import Decimal as D

    return spark.createDataFrame(
        [
            (1, 0, 1, "Mjölk", "mjölk", "m", 2.0, D("8.0000"), False, False),
            (1, 1, 2, "Pant", "pant", None, 1.0, D("2.0000"), False, True),
            (3, 0, 3, "Bröd", "bröd", None, 0.5, D("5.0000"), False, False),
            (3, 1, 4, "Rabatt", "rabatt", None, 1.0, D("-5.0000"), True, False),
            (99, 0, 5, "Lös", "lös", "m", 1.0, D("1.0000"), False, False),
        ],
        ITEMS,
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_receipt_filters(spark, receipts, items):
    links = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "receipt_id long, tag_id string")
    where = lambda **k: ids(filters.receipts_where(receipts, ReceiptFilter(**k), links, items))
    assert where() == [1, 2, 3, 5]
    assert where(statuses=("failed",)) == [3]
    assert where(categories=("a",)) == [1, 5]  # a null category never matches
    assert where(date_from="2024-03-31") == [3]  # null dates fail any bound, times do not count
    assert where(total_min=-1.0) == [1, 2, 5]  # a null total is 0
    assert where(tags=("x", "y")) == [1] and where(tags=("x",)) == [1, 3] and where(tags=("z",)) == []
    assert where(review=True) == [2, 3]
    assert where(query="ica lund") == [1, 5]
    assert where(query="mjölk bröd") == [1, 3]  # any term in an item, all in the receipt's own text
    assert where(query="nothing") == []


def test_filters_and_links():
    spec = ReceiptFilter(query="a b", tags=("x", "y"), total_min=1.5, review=True)
    assert ReceiptFilter.from_params(spec.to_params()) == spec
    assert ReceiptFilter().to_params() == {}
    assert filters.number("") == 0.0 and filters.number("x") is None and filters.number(None) is None
    item = PurchaseFilter(merchants=("ICA",), deposits=True)
    assert PurchaseFilter.from_params(item.to_params()) == item


def test_purchases(receipts, items):
    rows = lambda **k: sorted((r["receipt_id"], r["line_no"]) for r in filters.purchases(items, receipts, PurchaseFilter(**k)).collect())
    assert rows() == [(1, 0), (3, 0)]  # the orphan, the deposit and the discount are out
    assert rows(deposits=True, discounts=True) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert rows(merchants=("ica",)) == [(1, 0)]
    assert rows(query="bröd coop") == [(3, 0)] and rows(query="bröd ica") == []


def test_receipts_without_a_date_come_last(receipts):
    live = receipts.where("deleted_at = 0")
    order = lambda d: [r["id"] for r in live.orderBy(*filters.receipt_order("date", d)).collect()]
    assert order(False) == [1, 3, 5, 2] and order(True) == [3, 1, 5, 2]


def test_rollups(receipts, items):
    live = receipts.where("deleted_at = 0")
    months = {r["month"]: (r["total"], r["n"]) for r in rollups.by_month(live).collect()}
    assert months == {"2024-03": (5.0, 2), "okänt": (0.0, 2)}
    shops = {r["merchant"]: r["n"] for r in rollups.by_merchant(live).collect()}
    assert shops == {"ICA": 2, "Okänd butik": 1, "Coop": 1}
    cats = {r["category_id"]: r["total"] for r in rollups.by_category(filters.purchases(items, receipts)).collect()}
    assert cats == {"m": 8.0, None: 5.0}
    assert rollups.summary(live, items).first().asDict() == {"total": 5.0, "receipts": 4, "items": 4}
    c = rollups.compared(receipts.where("deleted_at in (0, 1)"), "2024-03-31").first()
    assert (c["current"], c["previous"]) == (5.0, 7.5)  # the day before is clamped to the 29th
    assert rollups.by_month(live.where("false")).count() == 0 and rollups.last_months(rollups.by_month(live)).count() == 0


def test_price_trend(spark, receipts, items):
    from decimal import Decimal as D

    rows = spark.createDataFrame([("p", f"2024-01-{i:02d}", i, 0, 1, D(i), 1.0) for i in range(1, 13)], "search_name string, purchased_at string, receipt_id int, line_no int, part_id int, total_price decimal(18,4), quantity double")
    r = rollups.price_trend(rows).first()
    assert (r["first"], r["last"], r["n"], r["highest"], r["change"]) == (1.0, 12.0, 12, 12.0, 1100.0)


def test_rules(spark):
    vat = "array<struct<rate:double,net:double,vat:double,gross:double>>"
    df = spark.createDataFrame(
        [
            (1, None, None, None, None, None, None, 0, None),
            (2, "a", "2024-01-01", 500.0, None, None, 25.0, 1, []),
            (3, "a", "2024-01-01", 42.0, 0.2, None, 41.8, 2, [(12.0, 10.0, 1.2, 42.0)]),
            (4, "a", "2030-01-01", -1.0, None, None, -1.0, 1, [(7.0, 10.0, 5.0, 9.0)]),
        ],
        f"id int, merchant string, purchased_at string, total double, rounding double, discount double, lines_total double, n_items int, vat_lines {vat}",
    )
    found = {}
    for r in quality.issues(df, "2026-01-01").collect():
        found.setdefault(r["id"], set()).add(r["code"])
    assert found == {1: {"merchant-missing", "date-missing", "total-missing", "items-missing"}, 2: {"total-mismatch"}, 4: {"date-future", "total-negative", "vat-mismatch", "vat-rate-unusual", "vat-line-mismatch"}}
    s = {r["id"]: r["ok"] for r in quality.severities(quality.issues(df, "2026-01-01")).collect()}
    assert s == {1: False, 2: False, 4: False}


CHANGES = "kind string, id long, updated_at long, deleted_at long, rev long, payload string"


def test_the_last_writer_wins_whatever_the_order(spark):
    rows = [("r", 1, 5, 0, 1, "a"), ("r", 1, 5, 5, 2, "a"), ("r", 1, 4, 0, 3, "z"), ("r", 2, 1, 0, 4, "a"), ("r", 2, 1, 0, 5, "b"), ("r", 2, 1, 0, 6, "b")]
    want = None
    for order in (rows, rows[::-1], rows + rows):
        got = sorted(map(tuple, replicate.resolve(spark.createDataFrame(order, CHANGES)).select("kind", "id", "deleted_at", "payload", "rev").collect()))
        want = want or got
        assert got == want == [("r", 1, 5, "a", 2), ("r", 2, 0, "b", 5)]


def test_pages_add_up_to_the_log(spark):
    log = spark.createDataFrame([("r", i, 1, 0, i, "") for i in range(1, 11)], CHANGES)
    seen, at = [], 0
    while True:
        page = [r["rev"] for r in replicate.pull(log, at, 3).collect()]
        more = replicate.has_more(log, at, 3)
        seen += page
        at = page[-1]
        if not more:
            break
    assert seen == list(range(1, 11))


def test_push_and_revisions(spark):
    stored = spark.createDataFrame([("r", 1, 5, 0, 1, "a")], CHANGES)
    incoming = spark.createDataFrame([("r", 1, 5, 0, 9, "a"), ("r", 1, 6, 0, 8, "a"), ("s", 2, 1, 0, 7, "")], CHANGES)
    out = {r["rev"]: r["outcome"] for r in replicate.outcomes(incoming, stored).collect()}
    assert out == {9: "stale", 8: "applied", 7: "applied"}  # an exact tie keeps what is stored
    revs = sorted(r["new_rev"] for r in replicate.revisions(incoming, 100, "rev").collect())
    assert revs == [101, 102, 103]


def test_enrichment(spark):
    r = spark.createDataFrame([(1, 0, "draft", None, "x"), (2, 0, "confirmed", None, None), (3, 4, "parsed", None, None), (4, 0, "parsed", "y", "x")], "id int, deleted_at int, status string, city string, org string")
    f = spark.createDataFrame([(i, "c", "o") for i in (1, 2, 3, 4)], "id int, city string, org string")
    got = {x["id"]: (x["city"], x["org"], x["status"], x["skipped"], x["filled"]) for x in replicate.enrich(r, f, ("city", "org")).collect()}
    assert got[1] == ("c", "x", "parsed", None, ["city"])
    assert got[2][3] == "confirmed" and got[3][3] == "deleted" and got[4][3] == "nothing-new"


def test_malformed_payloads_are_left_out(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "{"), (3, None)], "id int, payload string")
    assert [(r["id"], r["record"]["k"]) for r in decode(df, "k bigint").collect()] == [(1, 1)]


def test_jobs(spark):
    j = spark.createDataFrame([(1, "pending", 5, None, 1), (2, "pending", 500, "e", 2), (3, "failed", 0, "e", 3)], "receipt_id int, state string, next_attempt_at long, last_error string, updated_at long")
    assert [r["receipt_id"] for r in jobs.claim(j, 10, 5).collect()] == [1]
    assert {r["state"]: (r["n"], r["waiting"]) for r in jobs.counts(j, 10).collect()} == {"pending": (2, 1), "running": (0, 0), "done": (0, 0), "failed": (1, 0), "skipped": (0, 0)}
    assert [r["receipt_id"] for r in jobs.recent_failures(j).collect()] == [3, 2]
    t = spark.createDataFrame([("running", 2, "fail", True), ("running", 0, "fail", True), ("running", 0, "fail", False), ("failed", 3, "requeue", True)], "s string, a int, e string, r boolean")
    assert [tuple(x[0]) for x in t.select(jobs.after(F.col("s"), F.col("a"), F.col("e"), F.col("r"))).collect()] == [("failed", 3), ("pending", 1), ("failed", 1), ("pending", 0)]


def test_blobs(spark):
    b = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, byte_size long")
    assert store.put(b, "id", ("byte_size",)).count() == 2
    refs = store.referenced(spark.createDataFrame([("a", None), ("c", "a")], "x string, y string"), ("x", "y"))
    assert ids(store.unreferenced(b, refs)) == ["b"] and ids(store.missing(refs, b)) == ["c"]
    assert {r["id"]: r["present"] for r in store.status(refs, b).collect()} == {"a": True, "c": False}


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "b.txt").write_bytes(b"hello")
    got = {r["path"].rsplit("/", 1)[1]: (r["mime_type"], r["error"]) for r in store.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": ("image/jpeg", None), "b.txt": (None, "not an image")}


def test_steadiness(spark):
    flat = [(0.0, 0.0)] * 4
    moved = [(50.0, 0.0)] * 4
    rows = [("s", i, ok, c, 100, 100) for i, (ok, c) in enumerate([(True, flat), (True, flat), (True, flat), (True, flat), (False, flat), (True, flat), (True, moved), (True, moved), (True, moved)])]
    df = spark.createDataFrame(rows, "session string, at int, is_receipt boolean, corners array<struct<x:double,y:double>>, width int, height int")
    assert [r["at"] for r in vision.steady(df).where("fire").orderBy("at").collect()] == [2, 8]


def test_flattening(spark):
    import numpy as np

    page = np.tile(np.linspace(80, 250, 64), (64, 1))
    page[20:24, 10:50] *= 0.3
    df = spark.createDataFrame([(1, 64, 64, bytearray(page.astype("uint8").tobytes()))], "id long, width int, height int, pixels binary")
    out = np.frombuffer(vision.flatten(df).first()["pixels"], np.uint8).reshape(64, 64)
    assert out[40].std() < page[40].std() and out[21, 30] < 100 < out[40, 30]


def test_records(spark):
    from tallyloom.operators import records

    seeds = records.seed_categories(spark)
    assert seeds.count() == 19 and seeds.select("id").distinct().count() == 19
    tags = spark.createDataFrame([("t1", "Mat", 0), ("t2", "resa", 5), ("t3", "Resa", 7)], "id string, name string, deleted_at long")
    wanted = spark.createDataFrame([("mat",), ("RESA",), ("ny",)], "name string")
    got = {r["name"]: (r["id"], r["action"]) for r in records.create_or_revive(tags, wanted).collect()}
    assert got["mat"] == ("t1", "keep") and got["RESA"] == ("t2", "revive") and got["ny"][1] == "create"
    items = spark.createDataFrame([(1, "a", "a", 1, 0), (2, "b", "b", 1, 0), (3, None, None, 1, 0)], "id int, name string, search_name string, updated_at long, dirty int")
    names = spark.createDataFrame([(1, "Röd Äpple!"), (2, "b"), (3, "c")], "id int, new_name string")
    out = {r["id"]: (r["name"], r["search_name"], r["updated_at"], r["dirty"]) for r in records.renamed(items, names, 9).collect()}
    assert out == {1: ("Röd Äpple!", "röd äpple", 9, 1), 2: ("b", "b", 1, 0), 3: ("c", "c", 9, 1)}
    a = records.stable_json(spark.createDataFrame([(1, None)], "b int, a string"), ["b", "a"]).first()["json"]
    assert a == '{"a":null,"b":1}'


def test_a_reading_replaces_lines(spark):
    from tallyloom.operators import records

    receipts = spark.createDataFrame([(1, "draft", None, "x", 1), (2, "draft", "Lund", "y", 1)], "id int, status string, city string, merchant string, updated_at long")
    items = spark.createDataFrame([(1, 0, "old", 0), (1, 1, "gone", 5), (2, 0, "stays", 0)], "receipt_id int, line_no int, name string, deleted_at long")
    readings = spark.createDataFrame([(1, "Malmö", None, [("n1",), ("n2",)])], "id int, city string, merchant string, items array<struct<name:string>>")
    heads, lines = records.apply_extraction(receipts, items, readings, ("city", "merchant"), 9)
    assert {r["id"]: (r["status"], r["city"], r["merchant"], r["updated_at"]) for r in heads.collect()} == {1: ("parsed", "Malmö", "x", 9), 2: ("draft", "Lund", "y", 1)}
    assert sorted((r["receipt_id"], r["line_no"], r["name"], r["deleted_at"]) for r in lines.collect()) == [(1, 0, "n1", 0), (1, 0, "old", 9), (1, 1, "gone", 5), (1, 1, "n2", 0), (2, 0, "stays", 0)]


def test_addresses_and_registry(spark):
    from tallyloom.operators import records

    urls = spark.createDataFrame([("http://localhost:8080//",), ("https://a.se/x/",), (None,)], "u string")
    assert [tuple(r) for r in urls.select(records.base_url(F.col("u")), records.is_loopback(F.col("u"))).collect()] == [("http://localhost:8080", True), ("https://a.se/x", False), (None, False)]
    raw = spark.createDataFrame([('{"data": {"organization_number": "5560125790", "name": "Volvo", "status": "Active", "sni_codes": [{"description": "cars"}]}}',), ('{"data": {"organization_number": "1", "name": "No"}}',), ("x",)], "raw string")
    got = records.flatten_registry(raw).collect()
    assert [(r["id"], r["name"], r["active"], r["industry"]) for r in got] == [("556012-5790", "Volvo", True, "cars")]
