"""Names and numbers in receipt text: cases with stated answers, and blocking against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom.functions import dates, money, text
from tallyloom.operators import filters, names


def test_every_number_of_a_line_is_found(spark):
    rows = [(1, "Org.nr 556012-5790, moms SE 556036-0793"), (2, "556012-5790 556036-0793"), (3, "5560I2-5790"), (4, "tel 08-123 45 67"), (5, None), (6, "")]
    got = names.org_numbers(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sorted((r["id"], r["digits"], r["labelled"], r["repaired"]) for r in got) == [
        (1, "5560125790", True, False), (1, "5560360793", True, False), (2, "5560125790", False, False), (2, "5560360793", False, False), (3, "5560125790", False, True),
    ]


def test_look_alikes_meet(spark):
    texts = spark.createDataFrame([(1, "IREA SVENSKA"), (2, "nothing here")], "id long, text string")
    companies = spark.createDataFrame([(9, "Ikea Svenska Försäljnings AB", True), (10, "Bauhaus", True)], "id long, name string, active boolean")
    assert [(r["id"], r["company_id"], r["score"], r["confirmed"]) for r in names.match_companies(texts, companies).collect()] == [(1, 9, 0.849, True)]


def test_blocking_loses_few_pairs(spark):
    rng = np.random.default_rng(3)
    pairs = {a: b for x, y in names.CONFUSED for a, b in ((x, y), (y, x))}
    letters = list("abcdefghijklmnoprstuvy")
    known = ["".join(rng.choice(letters, int(rng.integers(5, 10)))) + " " + "".join(rng.choice(letters, int(rng.integers(5, 10)))) for _ in range(60)]
    rows = []
    for i, name in enumerate(known):
        for _ in range(3):
            chars = list(name)
            for at in rng.choice(len(chars), 2, replace=False):
                chars[at] = pairs.get(chars[at], chars[at])
            rows.append((len(rows), f"tack {''.join(chars)} summa 12", i))
    companies = spark.createDataFrame([(i, n, True) for i, n in enumerate(known)], "id long, name string, active boolean")
    got = {r["id"]: r["company_id"] for r in names.match_companies(spark.createDataFrame(rows, "id long, text string, of long"), companies).collect()}
    want = {i: of for i, t, of in rows if names.score_name(known[of].split(), t.split())[1]}
    assert len(want) > 150 and np.mean([got.get(i) == of for i, of in want.items()]) > 0.97


def test_amounts_and_dates_of_receipts(spark):
    rounded = {1.005: 1.01, 2.675: 2.68, -1.005: -1.0, 0.285: 0.29, float("inf"): 0.0, 10.0: 10.0}
    df = spark.createDataFrame([(k,) for k in rounded], "v double")
    assert {r["v"]: r["r"] for r in df.select("v", money.round_half_up(F.col("v")).alias("r")).collect()} == rounded
    printed = {
        "2024-03-15": "2024-03-15", "2024-03-15 14:22": "2024-03-15T14:22:00", "2024-03-15T14:22:33": "2024-03-15T14:22:33", "15/3-24": "2024-03-15", "15.03.2024": "2024-03-15",
        "15 mars 2024": "2024-03-15", "240315": "2024-03-15", "2024-02-31": None, "inget datum": None, "": None, "2024-06-30 23:50": "2024-06-30T23:50:00", "1 maj": "2025-05-01",
    }
    df = spark.createDataFrame([(k,) for k in printed], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", dates.parse_date(F.col("t"), "2025-01-01").alias("d")).collect()} == printed


def test_lines_that_are_no_name(spark):
    lines = {
        "ICA Nära": True, "Storgatan 12": False, "123 45 Stockholm": False, "Tel 08-123": False, "www.ica.se": False, "Org.nr 556012-5790": False, "Kvitto": False, "12,50 kr": False,
        "Kl 14:22 idag": False, "Bauhaus & Co AB": True, "a@b.com": False,
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r["t"]: r["ok"] for r in df.select("t", names.plausible(F.col("t")).alias("ok")).collect()} == lines
    q = spark.createDataFrame([("ICA Nära AB (publ)",), ("Hem ek. för.",)], "t string")
    assert [r[0] for r in q.select(names.query_of(F.col("t"))).collect()] == ["ICA Nära", "Hem"]


def test_links_carry_order_and_presets():
    spec = filters.ReceiptFilter(query="x", sort="total", direction="asc")
    assert spec.to_params() == {"q": "x", "sort": "total", "dir": "asc"} and filters.ReceiptFilter.from_params(spec.to_params()) == spec
    assert filters.ReceiptFilter().to_params() == {} and filters.ReceiptFilter.from_params({"dir": "up"}).direction == "desc"
    assert filters.preset("month", "2024-05-20").date_from == "2024-05-01" and filters.preset("unread", "2024-05-20").statuses == ("draft", "failed")


def test_redaction_goes_down(spark):
    rows = [('{"x":[{"Device-Token":"a"}],"code":"b"}', "/auth/pair"), ("no json", "/"), (None, None), ('{"value":"s"}', "/secrets/1")]
    df = spark.createDataFrame(rows, "body string, path string")
    assert [r[0] for r in df.select(text.redact_json(F.col("body"), F.col("path"))).collect()] == ['{"x":[{"Device-Token":"[redacted]"}],"code":"[redacted]"}', "no json", None, '{"value":"[redacted]"}']
    h = spark.createDataFrame([({"Set-Cookie": "a", "Accept": "b"},)], "h map<string,string>")
    assert h.select(text.redact_headers(F.col("h"))).first()[0] == {"Set-Cookie": "[redacted]", "Accept": "b"}
