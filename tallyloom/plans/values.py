"""Queries over parsing and formatting functions. Printed forms are built from keys whose value is known, so the SQL
states what must come out and does not repeat the parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom import tables
from tallyloom.functions import codes, dates, display, money, text
from tallyloom.operators import names, quality
from tallyloom.operators.categories import guess
from tallyloom.operators.extract import pick_text
from tallyloom.operators.replicate import overlay
from tallyloom.plans.registry import query
from tallyloom.session import scratch
from tallyloom.sources import registry
from tallyloom.sources.adapter import Domain


def _k() -> F.Column:
    return F.col("o_orderkey")


def _c() -> F.Column:
    return F.col("o_custkey")


def _s(c) -> F.Column:
    return c.cast("string")


def _pad(c, n: int) -> F.Column:
    return F.lpad(_s(c), n, "0")


@query("round_money", "SELECT o_orderkey AS id, floor((o_totalprice / 7 + 2.220446049250313e-16) * 100 + 0.5) / 100 AS up, floor((-o_totalprice / 7 + 2.220446049250313e-16) * 100 + 0.5) / 100 AS down FROM orders", plain=True)
def round_money(d: Domain) -> DataFrame:
    v = F.col("o_totalprice") / 7
    return d.table("orders").select(_k().alias("id"), money.round_half_up(v).alias("up"), money.round_half_up(-F.col("o_totalprice") / 7).alias("down"))


@query("parse_amount", """SELECT o_orderkey AS id, CASE o_orderkey % 7
  WHEN 0 THEN CAST(o_orderkey * 100 + o_custkey % 100 AS DOUBLE) / 100 WHEN 1 THEN CAST(1000000 + (o_orderkey % 1000) * 1000 + o_custkey % 1000 AS DOUBLE)
  WHEN 2 THEN -CAST(o_orderkey * 100 + o_custkey % 100 AS DOUBLE) / 100 WHEN 3 THEN -CAST(o_orderkey * 100 + o_custkey % 100 AS DOUBLE) / 100
  WHEN 4 THEN CAST(o_orderkey AS DOUBLE) WHEN 5 THEN CAST(1000 + o_orderkey % 1000 AS DOUBLE) END AS amount FROM orders""", plain=True)
def parse_amount(d: Domain) -> DataFrame:
    cents = _pad(_c() % 100, 2)
    printed = (
        F.when(_k() % 7 == 0, F.concat(_s(_k()), F.lit(","), cents, F.lit(" kr")))
        .when(_k() % 7 == 1, F.concat(F.lit("1."), _pad(_k() % 1000, 3), F.lit("."), _pad(_c() % 1000, 3)))
        .when(_k() % 7 == 2, F.concat(_s(_k()), F.lit("."), cents, F.lit("-")))
        .when(_k() % 7 == 3, F.concat(F.lit("("), _s(_k()), F.lit(","), cents, F.lit(")")))
        .when(_k() % 7 == 4, F.concat(_s(_k()), F.lit(":-")))
        .when(_k() % 7 == 5, F.concat(F.lit("1 "), _pad(_k() % 1000, 3), F.lit(" SEK")))
        .otherwise("moms")
    )
    return d.table("orders").select(_k().alias("id"), money.parse_amount(printed).alias("amount"))


@query("parse_grouped", "SELECT o_orderkey AS id, CAST((1000 + o_orderkey % 1000) * 100 + o_custkey % 100 AS DOUBLE) / 100 AS both, CAST(1000 + o_orderkey % 1000 AS DOUBLE) AS lone FROM orders", plain=True)
def parse_grouped(d: Domain) -> DataFrame:
    head = F.concat(F.lit("1."), _pad(_k() % 1000, 3))
    return d.table("orders").select(_k().alias("id"), money.parse_amount(F.concat(head, F.lit(","), _pad(_c() % 100, 2))).alias("both"), money.parse_amount(head).alias("lone"))


@query("parse_quantity", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 1000 = 0 THEN 1.0 ELSE CAST(o_custkey % 1000 AS DOUBLE) / 1000 END AS quantity, CASE o_orderkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'förp' WHEN 2 THEN 'st' ELSE 'other' END AS unit FROM orders", plain=True)
def parse_quantity(d: Domain) -> DataFrame:
    unit = F.when(_k() % 4 == 0, " Kg").when(_k() % 4 == 1, " frp").when(_k() % 4 == 2, "").otherwise(" burk")
    q = money.parse_quantity(F.concat(F.lit("0,"), _pad(_c() % 1000, 3), unit))
    return d.table("orders").select(_k().alias("id"), q["quantity"].alias("quantity"), q["unit"].alias("unit"))


@query("vat_rate", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 12.0 WHEN 1 THEN 25.0 WHEN 2 THEN 0.0 END AS rate FROM orders", plain=True)
def vat_rate(d: Domain) -> DataFrame:
    v = F.when(_k() % 4 == 0, 0.12).when(_k() % 4 == 1, -25.0).when(_k() % 4 == 2, 0.0).otherwise(250.0)
    return d.table("orders").select(_k().alias("id"), money.vat_rate(v).alias("rate"))


@query("derive_unit_price", "SELECT receipt_id, line_no, part_id, CASE WHEN is_discount THEN NULL ELSE floor(CAST(total_price AS DOUBLE) / quantity * 100 + 0.5) / 100 END AS unit_price FROM items WHERE quantity > 0")
def derive_unit_price(d: Domain) -> DataFrame:
    u = money.unit_price(F.lit(None).cast("double"), F.col("total_price").cast("double"), F.col("quantity"), F.col("is_discount"))
    return d.items.where("quantity > 0").select("receipt_id", "line_no", "part_id", u.alias("unit_price"))


@query("derive_gross", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 5.0 ELSE floor((o_totalprice + 1.5) * 100 + 0.5) / 100 END AS gross FROM orders", plain=True)
def derive_gross(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), money.gross(F.when(_k() % 2 == 0, 5.0), F.col("o_totalprice"), F.lit(1.5)).alias("gross"))


@query("backoff_ceiling", "SELECT o_orderkey AS id, least(30000.0 * CAST(power(2, o_orderkey % 9) AS DOUBLE), 1800000.0) AS ceiling FROM orders", plain=True)
def backoff(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), money.backoff_ceiling(_k() % 9 + 1).alias("ceiling"))


@query("search_name", "SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^\\pL\\pN]+', ' ', 'g')) AS name FROM customer", plain=True)
def search_name(d: Domain) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("id"), text.search_name(F.col("c_name")).alias("name"))


@query("tokenize", "SELECT c_custkey AS id, 'mjölk|röda äpplen|' || replace(lower(c_name), '#', ' ') AS terms FROM customer", plain=True)
def tokenize(d: Domain) -> DataFrame:
    q = F.concat(F.lit('Mjölk! "Röda, äpplen" -- '), F.col("c_name"))
    return d.table("customer").select(F.col("c_custkey").alias("id"), F.array_join(text.tokenize(q), "|").alias("terms"))


@query("fold", "SELECT c_custkey AS id, 'raksmorgas creme ' || replace(lower(c_name), '#', ' ') AS folded FROM customer", plain=True)
def fold(d: Domain) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("id"), text.fold(F.concat(F.lit("Räksmörgås, Crème "), F.col("c_name"))).alias("folded"))


@query("significant_tokens", "SELECT c_custkey AS id, 'volvo|' || replace(lower(c_name), '#', '|') AS tokens, 'ab' AS left_over FROM customer", plain=True)
def significant_tokens(d: Domain) -> DataFrame:
    t = lambda c: F.array_join(text.significant_tokens(c), "|")
    return d.table("customer").select(F.col("c_custkey").alias("id"), t(F.concat(F.lit("AB Volvo (publ) & "), F.col("c_name"))).alias("tokens"), t(F.lit("AB")).alias("left_over"))


@query("classify_line", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'deposit' WHEN 1 THEN 'discount' WHEN 2 THEN 'discount' WHEN 3 THEN 'product' ELSE 'discount' END AS kind FROM orders", plain=True)
def classify_line(d: Domain) -> DataFrame:
    name = F.when(_k() % 5 == 0, "PANT burk rabatt").when(_k() % 5 == 1, "Medlemspris").when(_k() % 5 == 2, "rea tröja").when(_k() % 5 == 3, "realtid pantry").otherwise("Banan")
    return d.table("orders").select(_k().alias("id"), quality.line_class(name, F.when(_k() % 5 == 4, -1.0).otherwise(1.0)).alias("kind"))


@query("guess_category", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'mejeri' WHEN 1 THEN 'frukt-gront' WHEN 2 THEN 'kott-fisk' WHEN 3 THEN 'pant' END AS slug FROM orders", plain=True)
def guess_category(d: Domain) -> DataFrame:
    name = F.when(_k() % 5 == 0, "mellanmjölk ris").when(_k() % 5 == 1, "banan eko").when(_k() % 5 == 2, "falukorv salt").when(_k() % 5 == 3, "pant").otherwise("zzz")
    return d.table("orders").select(_k().alias("id"), guess(name).alias("slug"))


@query("clean_codes", "SELECT o_orderkey AS id, CASE WHEN length('73' || o_orderkey) BETWEEN 8 AND 14 THEN '73' || o_orderkey END AS ean, right('12' || lpad(CAST(o_custkey AS VARCHAR), 6, '0'), 4) AS last4 FROM orders", plain=True)
def clean_codes(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), codes.ean(F.concat(F.lit("7-3 "), _s(_k()))).alias("ean"), codes.last4(F.concat(F.lit("*12** "), _pad(_c(), 6))).alias("last4"))


@query("null_placeholders", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN 'nothing' END AS value FROM orders", plain=True)
def null_placeholders(d: Domain) -> DataFrame:
    v = F.element_at(F.array(*[F.lit(x) for x in (" N/A", "okänd ", "null", "--", "  ", " nothing ")]), (_k() % 6 + 1).cast("int"))
    return d.table("orders").select(_k().alias("id"), text.nothing_to_null(v).alias("value"))


_ORG = "lpad(CAST((o_orderkey * 7919 + o_custkey * 104729) % 10000000000 AS VARCHAR), 10, '0')"


def _org() -> F.Column:
    return F.lpad(_s((_k() * 7919 + _c() * 104729) % 10000000000), 10, "0")


@query("org_vat_number", f"WITH t AS (SELECT o_orderkey AS id, {_ORG} AS n FROM orders) SELECT id, substr(n, 1, 6) || '-' || substr(n, 7) AS org, 'SE' || n || '01' AS vat FROM t", plain=True)
def org_vat_number(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), codes.org_number(F.concat(F.lit("16"), F.substring(_org(), 1, 6), F.lit(" - "), F.substring(_org(), 7, 4))).alias("org"), codes.vat_number(F.concat(F.lit(" "), _org())).alias("vat"))


_LUHN = "(SELECT sum(CASE WHEN i % 2 = 1 THEN (CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END) % 10 FROM (SELECT i, CAST(substr(n, i, 1) AS INTEGER) AS d FROM (SELECT unnest(range(1, 11)) AS i)))"


@query("luhn", f"WITH t AS (SELECT o_orderkey AS id, {_ORG} AS n FROM orders) SELECT id, {_LUHN} = 0 AS valid FROM t", plain=True)
def luhn(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), codes.luhn(_org()).alias("valid"))


@query("check_org_number", f"""WITH t AS (SELECT o_orderkey AS id, {_ORG} AS n FROM orders)
SELECT id, CASE WHEN substr(n, 1, 1) NOT IN ('1','2','3','5','6','7','8','9') THEN 'group-digit' WHEN CAST(substr(n, 3, 2) AS INTEGER) < 20 THEN 'not-an-org-number' WHEN {_LUHN} <> 0 THEN 'checksum' END AS reason FROM t""", plain=True)
def check_org_number(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), codes.check_org_number(_org())["reason"].alias("reason"))


@query("org_score", "SELECT o_orderkey AS id, round(0.7 + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN o_orderkey % 10 = 5 THEN 0.05 WHEN o_orderkey % 10 IN (1, 3, 6) THEN -0.15 ELSE 0 END - CASE WHEN o_custkey % 2 = 0 THEN 0.2 ELSE 0 END, 6) AS score FROM orders", plain=True)
def org_score(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), F.round(codes.org_score(_k() % 2 == 0, _c() % 2 == 0, _s(_k() % 10)), 6).alias("score"))


@query("digest", "SELECT c_custkey AS id, sha256(c_name) AS digest, true AS ok FROM customer", plain=True)
def digest(d: Domain) -> DataFrame:
    h = codes.digest(F.col("c_name"))
    return d.table("customer").select(F.col("c_custkey").alias("id"), h.alias("digest"), codes.is_digest(h).alias("ok"))


@query("parse_date", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T09:05:00'
  WHEN 4 THEN '2026-' || strftime(o_orderdate, '%m') || '-11' END AS value FROM orders""", plain=True)
def parse_date(d: Domain) -> DataFrame:
    at = F.col("o_orderdate")
    form = lambda f: F.date_format(at, f)
    month = F.element_at(F.array(*[F.lit(v[-1]) for v in dates.MONTHS.values()]), F.month(at))
    printed = (
        F.when(_k() % 6 == 0, form("yyyy/M/d")).when(_k() % 6 == 1, form("d.M.yyyy")).when(_k() % 6 == 2, F.concat(F.lit("Datum "), form("yyMMdd")))
        .when(_k() % 6 == 3, F.concat(form("yyyy-MM-dd"), F.lit(" 9:05"))).when(_k() % 6 == 4, F.concat(F.lit("11 "), month)).otherwise("2024-02-31")
    )
    return d.table("orders").select(_k().alias("id"), dates.parse_date(printed, "2026-01-01").alias("value"))


@query("date_keys", "SELECT id, substr(purchased_at, 1, 7) AS month, substr(purchased_at, 1, 10) AS d, date_diff('day', CAST(purchased_at AS DATE), DATE '2001-08-01') <= 400 AS recent FROM receipts")
def date_keys(d: Domain) -> DataFrame:
    c = F.col("purchased_at")
    return d.receipts.select("id", dates.month_key(c).alias("month"), dates.day_key(c).alias("d"), dates.within_days(c, "2001-08-01", 400).alias("recent"))


@query("relative_time", """WITH t AS (SELECT o_orderkey AS id, CAST(o_orderkey * 97 % 4000000 AS DOUBLE) AS s FROM orders), m AS (SELECT *, floor(s / 60 + 0.5) AS mi FROM t), h AS (SELECT *, floor(mi / 60 + 0.5) AS ho FROM m), d AS (SELECT *, floor(ho / 24 + 0.5) AS da FROM h)
SELECT id, CASE WHEN s < 45 THEN 'nyss' WHEN s < 90 THEN 'för en minut sedan' WHEN mi < 60 THEN 'för ' || CAST(mi AS BIGINT) || ' min sedan' WHEN ho < 24 THEN 'för ' || CAST(ho AS BIGINT) || ' tim sedan' WHEN da < 30 THEN 'för ' || CAST(da AS BIGINT) || ' dagar sedan' END AS ago FROM d""", plain=True)
def relative_time(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), dates.relative_time((_k() * 97 % 4000000).cast("double")).alias("ago"))


@query("format_money", "SELECT o_orderkey AS id, replace(format('{:,}', o_orderkey * 1009), ',', chr(160)) || ',' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || chr(160) || 'kr' AS money FROM orders", plain=True)
def format_money(d: Domain) -> DataFrame:
    v = (_k() * 100900 + _c() % 100).cast("decimal(18,0)") / 100
    return d.table("orders").select(_k().alias("id"), display.format_money(v.cast("decimal(18,2)")).alias("money"))


@query("format_bytes", "WITH t AS (SELECT o_orderkey AS id, o_orderkey * o_custkey * 37 % 50000000 AS n FROM orders) SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(CAST(floor(n / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' kB' ELSE replace(CAST(floor(n * 10 / 1048576.0 + 0.5) / 10 AS VARCHAR), '.', ',') || ' MB' END AS size FROM t", plain=True)
def format_bytes(d: Domain) -> DataFrame:
    return d.table("orders").select(_k().alias("id"), display.format_bytes(_k() * _c() * 37 % 50000000).alias("size"))


@query("format_month", "SELECT id, CASE substr(purchased_at, 6, 2) WHEN '01' THEN 'Januari' WHEN '02' THEN 'Februari' WHEN '03' THEN 'Mars' WHEN '04' THEN 'April' WHEN '05' THEN 'Maj' WHEN '06' THEN 'Juni' WHEN '07' THEN 'Juli' WHEN '08' THEN 'Augusti' WHEN '09' THEN 'September' WHEN '10' THEN 'Oktober' WHEN '11' THEN 'November' ELSE 'December' END || ' ' || substr(purchased_at, 1, 4) AS label FROM receipts")
def format_month(d: Domain) -> DataFrame:
    return d.receipts.select("id", dates.format_month(dates.month_key(F.col("purchased_at"))).alias("label"))


@query("json_pick", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN 'x' END AS value FROM events", plain=True)
def json_pick(d: Domain) -> DataFrame:
    i = F.col("event_id")
    v = F.when(i % 3 == 0, F.col("props")).when(i % 3 == 1, '{"total": "", "k": null, "amount": "x"}').otherwise('{"total": "n/a"}')
    return d.table("events").select(i.alias("id"), pick_text(F.parse_json(v), ("total", "k", "amount")).alias("value"))


@query("keep_known", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'here' ELSE 'there' END AS city FROM orders", plain=True)
def keep_known(d: Domain) -> DataFrame:
    new = F.struct(F.when(_k() % 2 == 0, "new").alias("name"), F.when(_k() % 3 == 0, "here").alias("city"))
    old = F.struct(F.lit("old").alias("name"), F.lit("there").alias("city"))
    return d.table("orders").select(_k().alias("id"), overlay(new, old, ("name", "city")).alias("m")).select("id", "m.name", "m.city")


@query("redact", "SELECT event_id AS id, 'token: \"[redacted]\" user=' || user_id AS line FROM events", plain=True)
def redact(d: Domain) -> DataFrame:
    line = F.concat(F.lit("token: a1-"), _s(F.col("event_id")), F.lit(" user="), _s(F.col("user_id")))
    return d.table("events").select(F.col("event_id").alias("id"), text.redact(line).alias("line"))


@query("header_score", "SELECT c_custkey AS id, round(greatest(0, least(1, 0.5 + 0.5 * exp(-(c_custkey % 14) / 3.0) + CASE WHEN c_custkey % 2 = 0 THEN 0.12 + 0.15 ELSE 0 END - CASE WHEN c_custkey % 3 = 0 THEN 0.2 ELSE 0 END - 0.05)), 6) AS score FROM customer", plain=True)
def header_score(d: Domain) -> DataFrame:
    i = F.col("c_custkey")
    line = F.concat(F.when(i % 2 == 0, "HANDLA AB ").otherwise("Handla hos "), _s(i), F.when(i % 3 == 0, " A B C D E").otherwise(""))
    return d.table("customer").select(i.alias("id"), F.round(names.header_score(line, i % 14), 6).alias("score"))


@query("looks_searchable", "SELECT c_custkey AS id, c_custkey % 5 IN (0, 3) AS ok FROM customer", plain=True)
def looks_searchable(d: Domain) -> DataFrame:
    i = F.col("c_custkey")
    q = F.element_at(F.array(*[F.lit(x) for x in ("Bauhaus", "B4uhaus", "BaUhaus", "Clas Ohlson", "Krrrdst")]), (i % 5 + 1).cast("int"))
    return d.table("customer").select(i.alias("id"), names.searchable(q).alias("ok"))


@query("name_similarity", "SELECT c_custkey AS id, greatest(0, 1 - levenshtein(lower(c_name), 'customer#' || c_custkey) / CAST(greatest(length(c_name), length('customer#' || c_custkey)) AS DOUBLE)) AS score FROM customer", plain=True)
def name_similarity(d: Domain) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("id"), names.similarity(F.lower("c_name"), F.concat(F.lit("customer#"), _s(F.col("c_custkey")))).alias("score"))


@query("domain_candidates", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'bygg' ELSE 'example' END AS query, CAST(CASE WHEN page_id % 3 = 0 THEN 0.85 ELSE 0.95 END AS DOUBLE) AS confidence, 'domain' AS source FROM pages UNION ALL SELECT page_id, 'byggsverige', 0.95, 'domain' FROM pages WHERE page_id % 3 = 0", plain=True)
def domain_candidates(d: Domain) -> DataFrame:
    """Names in addresses; what a domain appends to a name is also tried without."""
    site = F.when(F.col("page_id") % 3 == 0, "https://www.byggsverige.se/kvitto").otherwise(F.col("url"))
    found = names.name_candidates(d.table("pages").select(F.col("page_id").alias("id"), site.alias("text")))
    return found.select("id", "query", "confidence", "source")


_REAL = "CAST(5560000000 + (o_orderkey * {0} + o_custkey * 104729) % 40000000 AS VARCHAR)"


def _numbered(d: Domain) -> DataFrame:
    number = lambda m: (F.lit(5560000000) + (_k() * m + _c() * 104729) % 40000000).cast("string")
    dashed = lambda n: F.concat(F.substring(n, 1, 6), F.lit("-"), F.substring(n, 7, 4))
    between = F.when(_k() % 2 == 0, ", moms ").otherwise(F.concat(F.lit(", "), F.repeat(F.lit("x "), 25)))
    return d.table("orders").select(_k().alias("id"), F.concat(F.lit("Org.nr "), dashed(number(7919)), between, dashed(number(6841))).alias("text"))


@query("org_numbers", f"""WITH t AS (SELECT o_orderkey AS id, {_REAL.format(7919)} AS n, true AS labelled FROM orders UNION ALL SELECT o_orderkey, {_REAL.format(6841)}, o_orderkey % 2 = 0 FROM orders),
c AS (SELECT id, n, bool_or(labelled) AS labelled FROM t WHERE CAST(substr(n, 3, 2) AS INTEGER) >= 20 AND {_LUHN} = 0 GROUP BY 1, 2)
SELECT id, n AS digits, labelled, CASE WHEN labelled THEN 1.0 ELSE 0.75 END AS confidence FROM c""", plain=True)
def org_numbers(d: Domain) -> DataFrame:
    """Two numbers in one line; the second's label is in reach of every other receipt only."""
    return names.org_numbers(_numbered(d)).select("id", "digits", "labelled", F.round("confidence", 6).alias("confidence"))


@query("purchase_dates", """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || 'T09:05:00' AS value, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1999-06-01' THEN 0.4 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-06-01') <= 400 THEN 1.0 ELSE 0.85 END AS confidence FROM orders""", plain=True)
def purchase_dates(d: Domain) -> DataFrame:
    texts = d.table("orders").select(_k().alias("id"), F.concat(F.lit("Butiken\nDatum "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 9:05\nBäst före 2030-01-01\nsumma 12,50")).alias("text"))
    return names.purchase_dates(texts, "1999-06-01").select("id", "value", F.round("confidence", 6).alias("confidence"))


@query("round_small", "SELECT o_orderkey AS id, CAST(o_orderkey % 200 + 1 AS DOUBLE) / 100 AS up FROM orders", plain=True)
def round_small(d: Domain) -> DataFrame:
    """Halves of a hundredth, many of which are stored a little short."""
    return d.table("orders").select(_k().alias("id"), money.round_half_up((_k() % 200 * 2 + 1).cast("double") / 200).alias("up"))


@query("company_matches", "SELECT s_suppkey AS id, s_suppkey AS company_id, true AS confirmed FROM supplier", plain=True)
def company_matches(d: Domain) -> DataFrame:
    """Invented names, printed with look-alikes in the place of two of their letters."""
    key = F.col("s_suppkey")
    name = F.translate(F.substring(F.md5(key.cast("string")), 1, 14), "0123456789", "ghijklmnop")
    suppliers = d.table("supplier").select(key.alias("id"), name.alias("name"), (key % 4 != 0).alias("active"))
    texts = suppliers.select("id", F.concat(F.lit("Tack för besöket hos "), F.translate("name", "ok", "0r"), F.lit("! Summa 12,50 kr")).alias("text"))
    return names.match_companies(texts, suppliers.withColumn("name", F.concat("name", F.lit(" Handel AB")))).select("id", "company_id", "confirmed")


@query("org_number_places", f"""WITH t AS (SELECT o_orderkey AS id, {_REAL.format(7919)} AS n, true AS labelled, 7 AS p FROM orders UNION ALL SELECT o_orderkey, {_REAL.format(6841)}, o_orderkey % 2 = 0, CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 70 END FROM orders)
SELECT id, n AS digits, bool_or(labelled) AS labelled, first(p ORDER BY labelled DESC, p) AS \"at\" FROM t WHERE CAST(substr(n, 3, 2) AS INTEGER) >= 20 AND {_LUHN} = 0 GROUP BY 1, 2""", plain=True)
def org_number_places(d: Domain) -> DataFrame:
    """The numbers of org_numbers with the characters ahead of each, by a table function of SQL."""
    tables.register(d.spark)
    return d.spark.sql("SELECT t.id, f.digits, f.labelled, f.at FROM {texts} t, LATERAL tl_org_numbers(t.text) f", texts=_numbered(d))


@query("scanned_pieces", """SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS texts,
  first(strftime(o_orderdate, '%Y-%m-%d') || 'T09:05:00' ORDER BY CASE WHEN CAST(o_orderdate AS DATE) > DATE '1999-06-01' THEN 2 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-06-01') <= 400 THEN 0 ELSE 1 END, o_orderdate) AS value,
  'butik' || o_custkey AS name FROM orders GROUP BY o_custkey""", plain=True)
def scanned_pieces(d: Domain) -> DataFrame:
    """The best date and domain of all texts of a customer, by a table function over a partitioned table."""
    tables.register(d.spark)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    texts = d.table("orders").select(_c().alias("id"), F.concat(F.lit("www.butik"), _c().cast("string"), F.lit(".se\nDatum "), day, F.lit(" 9:05\nsumma 12,50")).alias("text"))
    return d.spark.sql("SELECT id, texts, value, name FROM tl_scan(TABLE(SELECT * FROM {texts}) PARTITION BY (id), DATE'1999-06-01')", texts=texts)


@query("registry_range", f"""WITH t AS (SELECT c_custkey AS k, CAST(5560000000 + c_custkey * 7919 % 40000000 AS VARCHAR) AS n FROM customer)
SELECT n AS id, 'Bolag ' || k AS name, k % 3 > 0 AS active, 'b' || k AS industry FROM t WHERE n BETWEEN '5560100000' AND '5580000000' AND {_LUHN} = 0""", plain=True)
def registry_range(d: Domain) -> DataFrame:
    """Customers' invented numbers stored as a registry in files, and a range of them read back by the data source."""
    k = F.col("c_custkey")
    n = (F.lit(5560000000) + k * 7919 % 40000000).cast("string")
    number = F.concat(F.substring(n, 1, 6), F.lit("-"), F.substring(n, 7, 4))
    raw = F.to_json(F.struct(number.alias("org_number"), F.concat(F.lit("Bolag "), _s(k)).alias("name"), (k % 3 > 0).alias("active"), F.array(F.struct(F.concat(F.lit("b"), _s(k)).alias("description"))).alias("sni_codes")))
    at = scratch(d.spark, "registry")
    registry.store(d.table("customer").select(number.alias("number"), raw.alias("raw")), at, files=8)
    some = d.spark.read.format("registry").load(at).where(F.col("number").between("556010-0000", "558000-0000"))
    return registry.valid(some).select("id", "name", "active", "industry")


@query("company_list", """WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 4 <> 0)
SELECT k AS id, name, false AS asked FROM c UNION ALL SELECT k, name, true FROM c WHERE k = 7""", plain=True)
def company_list(d: Domain) -> DataFrame:
    """Stored companies that are not deleted, and the one of a number that is written with its century."""
    k = F.col("c_custkey")
    ten = F.lpad((k * 100 + F.lit(5560120000)).cast("string"), 10, "0")
    stored = d.table("customer").select(ten.alias("id"), k.alias("k"), F.col("c_name").alias("name"), F.when(k % 4 == 0, 9).otherwise(0).alias("deleted_at"))
    one = registry.company(stored, "16556012-0700")
    rows = lambda df, asked: df.select(F.col("k").alias("id"), "name", F.lit(asked).alias("asked"))
    return rows(registry.companies(stored), False).unionByName(rows(one, True))


@query("registry_search", f"""WITH t AS (SELECT c_custkey AS k, CAST(5560000000 + c_custkey * 7919 % 40000000 AS VARCHAR) AS n FROM customer),
h AS (SELECT * FROM t WHERE k % 7 = 3 ORDER BY n LIMIT 10) SELECT n AS id, k FROM h WHERE {_LUHN} = 0""", plain=True)
def registry_search(d: Domain) -> DataFrame:
    """The first ten hits of a search in the registry's order, less those whose number does not hold."""
    k = F.col("c_custkey")
    n = (F.lit(5560000000) + k * 7919 % 40000000).cast("string")
    rows = d.table("customer").select(F.concat(F.substring(n, 1, 6), F.lit("-"), F.substring(n, 7, 4)).alias("number"), F.when(k % 7 == 3, "Bygg & Hem").otherwise("Bok").alias("name"), k.alias("k"), F.lit("").alias("raw"))
    return registry.search(rows, " bygg ").select("id", "k")
