"""Queries that change records, resolve companies by name, redact and format, and the SQL views and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import sql
from tallyloom.functions import display, text
from tallyloom.operators import filters, names, records, replicate
from tallyloom.plans.registry import query
from tallyloom.sources.adapter import Domain
from tallyloom.streaming import worker


def _k() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("o_custkey")


@query("dirty_scan", """, r AS (SELECT 'receipts' AS kind, CAST(id AS VARCHAR) AS id FROM receipts WHERE id % 4 = 0 ORDER BY updated_at, receipts.id LIMIT 40),
c AS (SELECT 'companies' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 = 0 ORDER BY -c_custkey LIMIT 40) SELECT * FROM r UNION ALL SELECT * FROM c""")
def dirty_scan(d: Domain) -> DataFrame:
    r = d.receipts.select("id", "updated_at", (F.col("id") % 4 == 0).cast("int").alias("dirty"))
    k = F.col("c_custkey")
    c = d.table("customer").select(k.alias("id"), (-k).alias("updated_at"), (k % 3 == 0).cast("int").alias("dirty"))
    return records.dirty({"receipts": r, "companies": c}, 40).select("kind", "id")


@query("kv_read", "SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS value FROM customer", plain=True)
def kv_read(d: Domain) -> DataFrame:
    c = d.table("customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), "c_custkey")
    return records.kv_get(c.where("c_custkey % 2 = 0"), c.select("key", F.lit("none").alias("fallback")))


@query("kv_wipe", "SELECT 'settings:' || c_custkey AS key FROM customer WHERE c_custkey % 4 = 3 UNION ALL SELECT 'categories:seeded:' || c_custkey FROM customer WHERE c_custkey % 4 = 2", plain=True)
def kv_wipe(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    start = F.element_at(F.array(*[F.lit(x) for x in ("sync:", "companies:", "categories:seeded:", "settings:")]), (k % 4 + 1).cast("int"))
    kv = d.table("customer").select(F.concat(start, k.cast("string")).alias("key"), F.lit("x").alias("value"))
    return records.wiped({}, kv.unionByName(kv.limit(1).select(F.lit("categories:seeded").alias("key"), "value")))[1].select("key")


def _lines(d: Domain) -> DataFrame:
    dead = F.when(F.col("line_no") % 5 == 0, 7).otherwise(0).cast("bigint")
    return d.items.select("receipt_id", "line_no", "part_id", "name", dead.alias("deleted_at"), F.lit(1).cast("bigint").alias("updated_at"), F.lit(0).alias("dirty"))


@query("delete_cascade", "SELECT receipt_id, line_no, part_id, CASE WHEN receipt_id % 4 = 0 THEN 99 WHEN line_no % 5 = 0 THEN 7 ELSE 0 END AS deleted_at, CAST(receipt_id % 4 = 0 AS INTEGER) AS dirty FROM items")
def delete_cascade(d: Domain) -> DataFrame:
    none = d.receipts.select("id", "deleted_at", "updated_at", F.lit(0).alias("dirty"))
    links = d.receipt_tags.select("receipt_id", "tag_id", F.lit(0).cast("bigint").alias("deleted_at"), F.lit(0).cast("bigint").alias("updated_at"), F.lit(0).alias("dirty"))
    return records.delete_receipts(none, _lines(d), links, d.receipts.where("id % 4 = 0").select("id"), 99)[1].select("receipt_id", "line_no", "part_id", "deleted_at", "dirty")


@query("restore_cascade", "SELECT receipt_id, line_no, part_id, CASE WHEN line_no % 5 = 0 THEN CASE WHEN receipt_id % 4 = 0 THEN 0 ELSE 7 END ELSE 0 END AS deleted_at FROM items")
def restore_cascade(d: Domain) -> DataFrame:
    """Lines with the tombstone 7 went with the receipts that carry it; those with another stay."""
    r = d.receipts.select("id", F.when(F.col("id") % 4 == 0, 7).otherwise(3).cast("bigint").alias("deleted_at"), "updated_at", F.lit(0).alias("dirty"))
    links = d.receipt_tags.select("receipt_id", "tag_id", F.lit(0).cast("bigint").alias("deleted_at"), F.lit(0).cast("bigint").alias("updated_at"), F.lit(0).alias("dirty"))
    return records.restore_receipts(r, _lines(d), links, d.receipts.select("id"), 100)[1].select("receipt_id", "line_no", "part_id", "deleted_at")


@query("item_add", "SELECT r.id AS receipt_id, coalesce(max(line_no) + 1, 0) AS line_no, 'ny rad' AS search_name FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id GROUP BY 1")
def item_add(d: Domain) -> DataFrame:
    old = _lines(d).withColumn("id", F.concat_ws("-", "receipt_id", "line_no", "part_id")).withColumn("search_name", F.col("name"))
    new = d.receipts.select(F.col("id").alias("receipt_id"), F.concat(F.lit("new-"), F.col("id").cast("string")).alias("id"))
    return records.added(old, new, 5).where("id like 'new-%'").select("receipt_id", "line_no", "search_name")


@query("live_item_counts", "SELECT r.id, count(i.receipt_id) AS item_count FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id AND line_no % 5 <> 0 GROUP BY 1")
def live_item_counts(d: Domain) -> DataFrame:
    return records.item_counts(d.receipts.select("id"), _lines(d)).select("id", F.col("item_count").cast("bigint").alias("item_count"))


_NAMED = """WITH q AS (SELECT o_orderkey AS id, 'namn ' || (o_custkey % 97) AS query, o_orderkey % 7 <> 0 AS searchable, o_custkey % 97 AS n FROM orders),
s AS (SELECT *, searchable AND n >= 60 AND row_number() OVER (PARTITION BY searchable AND n >= 60 ORDER BY id) <= 5 AS paid FROM q)"""


@query("company_by_name", _NAMED + """ SELECT id, CASE WHEN NOT searchable THEN 'no-query' WHEN n < 20 THEN 'cached' WHEN n < 40 THEN 'lookup' WHEN n < 60 THEN 'not-found' WHEN paid THEN 'search' ELSE 'budget-spent' END AS step,
  CASE WHEN searchable AND n < 40 THEN 'nr' || n END AS org_number FROM s""", plain=True)
def company_by_name(d: Domain) -> DataFrame:
    n = _c() % 97
    asked = d.table("orders").select(_k().alias("id"), F.concat(F.lit("namn "), n.cast("string")).alias("query"), F.lit(0.9).alias("confidence"), F.lit(0).alias("line"), (_k() % 7 != 0).alias("searchable"))
    keys = d.spark.range(60).select(F.concat(F.lit("namn "), F.col("id").cast("string")).alias("key"), F.when(F.col("id") < 40, F.concat(F.lit("nr"), F.col("id").cast("string"))).otherwise("").alias("org_number"), F.lit(10**12).alias("at"))
    old = d.spark.range(60, 70).select(F.concat(F.lit("namn "), F.col("id").cast("string")).alias("key"), F.lit("nr1").alias("org_number"), F.lit(0).cast("bigint").alias("at"))
    stored = keys.where("org_number <> ''").select("org_number", F.when(F.regexp_extract("org_number", r"(\d+)", 1).cast("int") < 20, 0).otherwise(5).alias("deleted_at"))
    return names.resolve_by_name(asked, keys.unionByName(old), stored, 10**12 + 5, 3).select("id", "step", "org_number")


@query("enrich_from_text", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'old' WHEN o_orderkey % 5 <> 0 THEN '2024-01-02' END AS purchased_at,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'mine' END WHEN o_custkey % 4 = 0 THEN 'byname' WHEN o_orderkey % 3 = 0 THEN 'mine' ELSE 'read' END AS org_number,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 1 END END AS company_id, CASE WHEN o_orderkey % 5 = 0 THEN 'no-text' END AS reason FROM orders""", plain=True)
def enrich_from_text(d: Domain) -> DataFrame:
    o = d.table("orders")
    r = o.select(_k().alias("id"), F.when(_k() % 2 == 0, "old").alias("purchased_at"), F.when(_k() % 3 == 0, "mine").alias("org_number"), F.lit(None).cast("string").alias("merchant"), F.lit(None).cast("int").alias("company_id"))
    found = o.select(_k().alias("id"), F.when(_k() % 5 != 0, "a text of some length").otherwise(" short ").alias("text"), F.lit("2024-01-02").alias("purchased_at"), F.lit("read").alias("org_number"))
    number = o.select(_k().alias("id"), F.lit(1).alias("company_id"), F.lit("One").alias("name"), F.lit("read").alias("org_number"), F.when(_c() % 4 == 0, 0.4).when(_c() % 4 == 1, 0.5).otherwise(0.8).alias("score"))
    name = o.select(_k().alias("id"), F.lit(2).alias("company_id"), F.lit("Two").alias("name"), F.lit("byname").alias("org_number"), F.when(_c() % 4 == 1, 0.3).otherwise(0.7).alias("score"))
    return names.enrich_from_text(r, found, number, name).select("id", "purchased_at", "org_number", "company_id", "reason")


@query("merge_blocks", """SELECT id, CASE WHEN id % 2 = 0 THEN 'mine' WHEN id % 3 = 0 THEN 'theirs' END AS org, CASE WHEN id % 5 = 0 THEN 2 WHEN id % 7 = 0 THEN 3 ELSE 0 END AS n_vat, CASE WHEN id % 11 = 0 THEN 1 ELSE 2 END AS n_items,
  CASE WHEN id % 11 = 0 THEN 'SEK' ELSE 'EUR' END AS currency FROM receipts WHERE deleted_at = 0 AND status <> 'confirmed'""")
def merge_blocks(d: Domain) -> DataFrame:
    """VAT lines and items come whole or not at all, the number once set stays, the currency only without items."""
    i = F.col("id")
    some = lambda n: F.array_repeat(F.lit(1), n)
    none = F.array().cast("array<int>")
    r = d.live.where("status <> 'confirmed'").select("id", "deleted_at", "status", F.when(i % 2 == 0, "mine").alias("org"), F.when(i % 5 == 0, some(2)).otherwise(none).alias("vat"), F.when(i % 11 == 0, some(1)).otherwise(none).alias("items"), F.lit("SEK").alias("currency"), F.lit(True).alias("machine"))
    f = d.live.select("id", F.when(i % 3 == 0, "theirs").alias("org"), F.when(i % 7 == 0, some(3)).otherwise(none).alias("vat"), some(2).alias("items"), F.lit("EUR").alias("currency"))
    out = replicate.enrich(r, f, ("org",), fixed=("org",), blocks=("vat",), replace_own=False)
    return out.select("id", "org", F.size("vat").alias("n_vat"), F.size("items").alias("n_items"), "currency")


@query("quick_filters", "SELECT id, 'unread' AS preset FROM live WHERE status = 'failed' UNION ALL SELECT id, 'month' FROM live WHERE purchased_at >= '1998-05-01' UNION ALL SELECT id, 'review' FROM live WHERE CASE status WHEN 'failed' THEN true WHEN 'confirmed' THEN false ELSE warned END")
def quick_filters(d: Domain) -> DataFrame:
    parts = [filters.receipts_where(d.receipts, filters.preset(p, "1998-05-20")).select("id", F.lit(p).alias("preset")) for p in ("unread", "month", "review")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("redact_deep", """SELECT event_id AS id, '{"a":{"apiKey":"[redacted]","n":' || user_id || '},"secrets":[{"id":"x","value":"[redacted]"}],"value":1}' AS body, '/sync/' || event_id || '?access_token=%5Bredacted%5D&page=2' AS url FROM events""", plain=True)
def redact_deep(d: Domain) -> DataFrame:
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    body = F.concat(F.lit('{"a": {"apiKey": "k'), i, F.lit('", "n": '), u, F.lit('}, "secrets": [{"id": "x", "value": "v"}], "value": 1}'))
    url = F.concat(F.lit("https://host.example/sync/"), i, F.lit("?access_token=t"), u, F.lit("&page=2#x"))
    return d.table("events").select(F.col("event_id").alias("id"), text.redact_json(body, F.lit("/sync")).alias("body"), text.redact_url(url).alias("url"))


@query("format_values", """SELECT o_orderkey AS id, replace(format('{:,}', o_orderkey * 1009), ',', chr(160)) || ',' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS amount,
  CASE WHEN o_custkey % 1000 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE (o_orderkey % 9) || ',' || rtrim(lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'), '0') END AS quantity,
  strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || ' 09:05' AS at, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'st' END AS unit FROM orders""", plain=True)
def format_values(d: Domain) -> DataFrame:
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T09:05:30"))
    amount = ((_k() * 100900 + _c() % 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    quantity = ((_k() % 9 * 1000 + _c() % 1000).cast("decimal(9,0)") / 1000).cast("decimal(9,3)")
    return d.table("orders").select(
        _k().alias("id"), display.format_amount(amount).alias("amount"), display.format_quantity(quantity).alias("quantity"), display.format_date(at).alias("day"),
        display.format_date_time(at).alias("at"), display.format_unit(F.when(_k() % 2 == 0, "other").otherwise("st")).alias("unit"),
    )


_TABLE = """WITH jobs AS (SELECT event_id AS receipt_id, CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'done' END AS state, event_id * 37 % 1000 AS due, CAST(event_id % 3 AS INTEGER) AS attempts FROM events),
claimed AS (SELECT receipt_id FROM jobs WHERE state = 'pending' AND due <= 400 ORDER BY due, receipt_id LIMIT 50)"""


@query("job_pass", _TABLE + """ SELECT receipt_id, CASE WHEN receipt_id NOT IN (SELECT receipt_id FROM claimed) THEN state WHEN receipt_id % 3 = 0 THEN 'done' WHEN receipt_id % 3 = 1 AND attempts + 1 < 3 THEN 'pending' WHEN receipt_id % 3 = 1 THEN 'failed' ELSE 'skipped' END AS state,
  attempts + CASE WHEN receipt_id IN (SELECT receipt_id FROM claimed) AND receipt_id % 3 = 1 THEN 1 ELSE 0 END AS attempts FROM jobs""", plain=True)
def job_pass(d: Domain) -> DataFrame:
    i = F.col("event_id")
    table = d.table("events").select(i.alias("receipt_id"), F.lit("i").alias("image_id"), F.when(i % 4 == 0, "pending").otherwise("done").alias("state"), (i % 3).cast("int").alias("attempts"), (i * 37 % 1000).alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"), F.lit(0).cast("bigint").alias("updated_at"))

    def extract(claimed: DataFrame) -> DataFrame:
        k: Column = F.col("receipt_id") % 3
        return claimed.select("receipt_id", F.when(k == 0, "succeed").when(k == 1, "fail").otherwise("skip").alias("event"), F.lit("busy").alias("error"), F.lit(True).alias("retryable"))

    receipts = d.table("events").select(i.alias("id"), F.lit("i").alias("image_id"), i.alias("rev"))
    return worker.run_pass(receipts, table, extract, 400, 50).select("receipt_id", "state", "attempts")


@query("sql_surface", ", p AS (SELECT i.receipt_id, substr(r.purchased_at, 1, 7) AS month, CASE WHEN quantity > 0 AND NOT is_discount THEN floor((CAST(total_price AS DOUBLE) / quantity + 2.220446049250313e-16) * 100 + 0.5) / 100 END AS u FROM items i JOIN live r ON r.id = i.receipt_id) SELECT month, count(*) AS n, max(u) AS dearest FROM p GROUP BY 1")
def sql_surface(d: Domain) -> DataFrame:
    return sql.register(d.spark, d.sf_dir, "tl_").sql("""
        SELECT tl_month_key(purchased_at) AS month, count(*) AS n, max(tl_unit_price(CAST(total_price AS DOUBLE), quantity, is_discount)) AS dearest
        FROM tl_items i JOIN tl_live r ON r.id = i.receipt_id GROUP BY 1""")


@query(
    "cascade_tables",
    """, d AS (SELECT 'receipts' AS sort, CAST(id AS VARCHAR) AS id, CASE WHEN id % 4 = 0 THEN 99 ELSE 0 END AS gone, CASE WHEN id % 8 = 0 THEN 0 WHEN id % 4 = 0 THEN 99 ELSE 0 END AS back FROM receipts
UNION ALL SELECT 'items', receipt_id || '-' || line_no || '-' || part_id, CASE WHEN receipt_id % 4 = 0 THEN 99 WHEN line_no % 5 = 0 THEN 7 ELSE 0 END,
  CASE WHEN receipt_id % 8 = 0 THEN 0 WHEN receipt_id % 4 = 0 THEN 99 WHEN line_no % 5 = 0 THEN 7 ELSE 0 END FROM items
UNION ALL SELECT 'links', receipt_id || '-' || tag_id, CASE WHEN receipt_id % 4 = 0 THEN 99 ELSE 0 END, CASE WHEN receipt_id % 8 = 0 THEN 0 WHEN receipt_id % 4 = 0 THEN 99 ELSE 0 END FROM receipt_tags)
SELECT sort, id, gone, back, CAST(gone = 99 AS INTEGER) AS dirty FROM d""",
)
def cascade_tables(d: Domain) -> DataFrame:
    """Every fourth receipt deleted and every eighth brought back, in all three tables at both times. The deletion gives
    lines that were deleted before the receipt's time too, as it goes by the receipt, so they come back with it."""
    zero = F.lit(0).cast("bigint")
    key = {"receipts": F.col("id").cast("string"), "items": F.concat_ws("-", "receipt_id", "line_no", "part_id"), "links": F.concat_ws("-", "receipt_id", "tag_id")}
    r = d.receipts.select("id", zero.alias("deleted_at"), "updated_at", F.lit(0).alias("dirty"))
    links = d.receipt_tags.select("receipt_id", "tag_id", zero.alias("deleted_at"), zero.alias("updated_at"), F.lit(0).alias("dirty"))
    gone = records.delete_receipts(r, _lines(d), links, r.where("id % 4 = 0").select("id"), 99)
    back = records.restore_receipts(*gone, r.where("id % 8 = 0").select("id"), 120)
    out = None
    for sort, before, after in zip(key, gone, back, strict=True):
        k = key[sort].alias("id")
        # lines may repeat in all of their columns, and then they are alike
        a = before.groupBy(k).agg(F.max("deleted_at").alias("gone"), F.max("dirty").alias("dirty"), F.count(F.lit(1)).alias("_n"))
        b = after.groupBy(k).agg(F.max("deleted_at").alias("back"))
        both = a.join(b, "id").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(F.lit(sort).alias("sort"), "id", "gone", "back", "dirty")
        out = both if out is None else out.unionByName(both)
    return out


@query(
    "company_choice",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE s_suppkey + 100000 END AS company_id, CASE WHEN s_suppkey % 4 = 0 THEN 0.971 ELSE 1.0 END AS score, true AS confirmed
FROM supplier WHERE s_suppkey % 5 <> 0""",
    plain=True,
)
def company_choice(d: Domain) -> DataFrame:
    """Two companies a name, one a look-alike letter off: the exact one is chosen unless it is inactive, as an inactive
    challenger loses more than that letter costs. Every fifth text names nobody."""
    key = F.col("s_suppkey")
    rest = F.translate(F.substring(F.md5(key.cast("string")), 1, 13), "0123456789", "ghijklmnop")
    s = d.table("supplier").select(key.alias("id"), rest.alias("rest"))
    near = s.select("id", F.concat(F.lit("m"), "rest").alias("name"), F.lit(True).alias("active"))
    exact = s.select((F.col("id") + 100_000).alias("id"), F.concat(F.lit("n"), "rest").alias("name"), (F.col("id") % 4 != 0).alias("active"))
    texts = s.select("id", F.concat(F.lit("Tack! "), F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("N"), "rest")), F.lit(" Summa 12,50 kr")).alias("text"))
    return names.match_companies(texts, near.unionByName(exact)).select("id", "company_id", "score", "confirmed")


@query(
    "merge_own",
    """SELECT id, CASE WHEN deleted_at = 0 AND status <> 'confirmed' AND (id % 2 = 1 OR (id % 3 = 0 AND id % 10 <> 0)) THEN 'new' WHEN id % 2 = 0 THEN 'old' END AS city,
  CASE WHEN id % 2 = 0 THEN 'old' WHEN deleted_at = 0 AND status <> 'confirmed' THEN 'new' END AS org,
  CASE WHEN deleted_at <> 0 THEN 'deleted' WHEN status = 'confirmed' THEN 'confirmed' WHEN id % 2 = 0 AND (id % 3 <> 0 OR id % 10 = 0) THEN 'nothing-new' END AS skipped FROM receipts""",
)
def merge_own(d: Domain) -> DataFrame:
    """What a machine wrote is replaced by a later reading, but for a number that is once set; what a user wrote stays."""
    i = F.col("id")
    old = F.when(i % 2 == 0, "old")
    r = d.receipts.select("id", "deleted_at", "status", old.alias("city"), old.alias("org"), ((i % 3 == 0) & (i % 10 != 0)).alias("machine"))
    found = r.select("id", F.lit("new").alias("city"), F.lit("new").alias("org"))
    return replicate.enrich(r, found, ("city", "org"), fixed=("org",), replace_own=True).select("id", "city", "org", "skipped")
