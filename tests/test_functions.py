"""Values in, values out."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import codes, dates, display, money, text
from tallyloom.operators import extract, names, quality
from tallyloom.operators.categories import guess


def apply(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_amounts(spark):
    printed = ["1 234,50 kr", "1.234,50", "12:-", "25,00-", "(12,50)", "1,234", "kr", None, "", "--5", "1.234.567", "0,5"]
    assert apply(spark, money.parse_amount, *printed) == [1234.5, 1234.5, 12.0, -25.0, -12.5, 1234.0, None, None, None, -5.0, 1234567.0, 0.5]


def test_quantities(spark):
    got = apply(spark, money.parse_quantity, "0,412 kg", "3 frp", "", None, "2 burk", "0")
    assert [(r["quantity"], r["unit"]) for r in got] == [(0.412, "kg"), (3.0, "förp"), (1.0, "st"), (1.0, "st"), (2.0, "other"), (1.0, "st")]


def test_rounding_goes_up_at_halves(spark):
    assert apply(spark, money.round_half_up, 2.125, -2.125, None, float("nan"), kind="double") == [2.13, -2.12, None, 0.0]


def test_dates(spark):
    printed = ["15/3-24", "15 mars 2024", "240315", "2024-06-30 23:50", "2024-02-31", "31.12.1999", "11 maj", None, "nothing", "12.30"]
    assert apply(spark, lambda c: dates.parse_date(c, "2026-01-01"), *printed) == ["2024-03-15", "2024-03-15", "2024-03-15", "2024-06-30T23:50:00", None, "1999-12-31", "2026-05-11", None, None, None]


def test_numbers_of_organisations(spark):
    assert apply(spark, codes.org_number, "165561234567", "556123-4567", "12") == ["556123-4567", "556123-4567", None]
    assert apply(spark, codes.vat_number, "5561234567", "SE556123456701", None) == ["SE556123456701", "SE556123456701", None]
    reasons = [r["reason"] for r in apply(spark, codes.check_org_number, "556012-5790", "8505151234", "0560125790", "5560125791", "123")]
    assert reasons == [None, "not-an-org-number", "group-digit", "checksum", "length"]
    assert apply(spark, codes.luhn_digit, "556012579") == [0]


def test_search_terms(spark):
    assert apply(spark, text.search_name, "ÄPPLE Röd, 1kg") == ["äpple röd 1kg"]
    assert apply(spark, text.tokenize, 'mjölk "röda äpplen"', "", None) == [["mjölk", "röda äpplen"], [], None]
    assert text.terms('Mjölk "röda, äpplen" --') == ["mjölk", "röda äpplen"]
    assert apply(spark, text.fold, "Räksmörgås, Crème") == ["raksmorgas creme"]
    assert apply(spark, text.significant_tokens, "AB Volvo (publ)", "AB") == [["volvo"], ["ab"]]


def test_redaction(spark):
    assert apply(spark, text.redact, 'password: "x y" z', "Bearer abc.def") == ['password: "[redacted]" z', "Bearer [redacted]"]


def test_display(spark):
    assert apply(spark, display.format_money, 1234.5, None, kind="double") == ["1 234,50 kr", "–"]
    assert apply(spark, display.format_bytes, 12, 2048, 3 * 1048576, kind="long") == ["12 B", "2 kB", "3,0 MB"]
    assert apply(spark, dates.format_month, "2024-03", None) == ["Mars 2024", "Utan datum"]
    assert apply(spark, dates.relative_time, 10.0, 60.0, 600.0, None, kind="double") == ["nyss", "för en minut sedan", "för 10 min sedan", "aldrig"]


def test_line_classes_and_categories(spark):
    assert apply(spark, lambda c: quality.line_class(c, F.lit(1.0)), "Pant burk", "Medlemspris", "rea", "realtid", "pantry") == ["deposit", "discount", "discount", "product", "product"]
    assert apply(spark, guess, "mellanmjölk", "falukorv", "zzz", None) == ["mejeri", "kott-fisk", None, None]


def test_weighted_distance():
    assert names.distance("irea", "ikea") < 0.5
    assert names.distance("abc", "abd") == 1.0
    score, confirmed = names.score_name(["volvo"], "valkommen till volvo personbilar".split())
    assert confirmed and score > 0.9
    assert names.score_name(["volvo"], "helt annat".split())[1] is False


def test_searchable_names(spark):
    assert apply(spark, names.searchable, "Bauhaus", "B4uhaus", "BaUhaus", "Krrrdst", "ab") == [True, False, False, False, False]


def test_name_candidates(spark):
    df = spark.createDataFrame([(1, "*** BAUHAUS ***\nStorgatan 1\nTel 08-123\nSumma 12,50\nwww.scandichotels.se\nbra varor bauhaus")], "id int, text string")
    got = {(r["query"], r["source"]) for r in names.name_candidates(df).collect()}
    assert ("BAUHAUS", "header") in got and ("scandichotels", "domain") in got and ("scandic", "domain") in got
    assert not any("gatan" in q.lower() for q, _ in got)


def test_org_numbers_in_text(spark):
    df = spark.createDataFrame([(1, "Org.nr: 556012-5790\nx"), (2, "ring S56012-5790 nu"), (3, None), (4, "1234567890")], "id int, text string")
    got = {(r["id"], r["digits"], r["repaired"], r["labelled"]) for r in names.org_numbers(df).collect()}
    assert got == {(1, "5560125790", False, True), (2, "5560125790", True, False)}


def test_purchase_dates(spark):
    df = spark.createDataFrame([(1, "Datum 2026-09-10 12:30\nBäst före 2027-01-01"), (2, "")], "id int, text string")
    got = sorted(names.purchase_dates(df, "2026-09-13").collect(), key=lambda r: -r["confidence"])
    assert (got[0]["id"], got[0]["value"], round(got[0]["confidence"], 2)) == (1, "2026-09-10T12:30:00", 1.0)
    assert not any(r["value"].startswith("2027") for r in got)  # a line about another date


def test_company_matches(spark):
    texts = spark.createDataFrame([(1, "Tack från VOLVO personbilar"), (2, "helt annat")], "id int, text string")
    companies = spark.createDataFrame([(1, "AB Volvo (publ)", False), (2, "Volvo Bil", True), (3, "Saab", True)], "id int, name string, active boolean")
    got = names.match_companies(texts, companies).collect()
    assert [(r["id"], r["company_id"]) for r in got] == [(1, 1)]  # the first stays unless a later one scores more
    assert [r["company_id"] for r in names.match_companies(texts, companies, intended=True).collect()][0] in (1, 2)


def test_json_objects():
    assert extract.first_object('x {"a": "}"} y') == '{"a": "}"}'
    assert extract.first_object("```json\n{\"a\": {\"b\": 1}}\n```") == '{"a": {"b": 1}}'
    assert extract.first_object("[1]") is None and extract.first_object(None) is None and extract.first_object("{") is None


def test_extraction(spark):
    reading = """Here: {"store": {"name": "ICA", "orgnr": "5560125790"}, "date": "15/3-24", "currency": "sek", "items": [
      {"name": "Mjölk", "price": "12,50", "qty": "2 st"}, {"name": "PANT", "price": "2,00"}, {"name": "Rabatt", "price": "-3,00"},
      {"name": "Okänt"}, {"price": "5"}], "moms": [{"rate": "0,12", "net": "10", "vat": "1,20"}], "cardNumber": "**** 1234"}"""
    df = spark.createDataFrame([(1, reading), (2, "garbage"), (3, None)], "id int, json string")
    rows = {r["id"]: r for r in extract.normalize(df, "2026-01-01").collect()}
    r = rows[1]
    assert (r["merchant"], r["org_number"], r["purchased_at"], r["currency"], r["card_last4"]) == ("ICA", "556012-5790", "2024-03-15", "SEK", "1234")
    assert [(i["name"], i["total_price"], i["is_deposit"], i["is_discount"]) for i in r["items"]] == [("Mjölk", 12.5, False, False), ("PANT", 2.0, True, False), ("Rabatt", -3.0, False, True)]
    assert r["items"][0]["unit_price"] == 6.25 and r["deposit_total"] == 2.0
    assert r["vat_lines"][0]["rate"] == 12.0 and r["vat_lines"][0]["gross"] == 11.2 and r["total"] == 11.2
    assert set(r["warnings"]) == {"total from VAT lines", "no price: Okänt"} or "total from VAT lines" in r["warnings"]
    assert rows[2]["items"] == [] and rows[2]["warnings"] == ["no total"] and rows[3]["total"] is None


@pytest.mark.parametrize("value", ["", "-", "N/A", "okänd", "null"])
def test_nothing(spark, value):
    assert apply(spark, text.nothing_to_null, value, " a ") == [None, "a"]
