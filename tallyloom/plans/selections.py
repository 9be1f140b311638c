"""Queries that scan, filter, join and sort receipts and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import display
from tallyloom.operators import filters, store
from tallyloom.operators.filters import PurchaseFilter, ReceiptFilter
from tallyloom.operators.order import placed
from tallyloom.plans.registry import query
from tallyloom.sources.adapter import Domain, decode, live


def _money() -> Column:
    return F.col("total").cast("double").alias("total")


def _price() -> Column:
    return F.col("total_price").cast("double").alias("total_price")


@query("live_scan", "SELECT id, purchased_at, CAST(total AS DOUBLE) AS total, status FROM live")
def live_scan(d: Domain) -> DataFrame:
    return live(d.receipts).select("id", "purchased_at", _money(), "status")


@query("point_lookup", "SELECT id, merchant, CAST(total AS DOUBLE) AS total FROM receipts WHERE id = 7")
def point_lookup(d: Domain) -> DataFrame:
    return d.receipts.where("id = 7").select("id", "merchant", _money())


@query("receipt_lines", "SELECT receipt_id, line_no, name, CAST(total_price AS DOUBLE) AS total_price FROM items WHERE receipt_id BETWEEN 10 AND 60")
def receipt_lines(d: Domain) -> DataFrame:
    return d.items.where("receipt_id between 10 and 60").select("receipt_id", "line_no", "name", _price())


@query("count_live_items", "SELECT CAST(count(*) AS BIGINT) AS n FROM changes WHERE kind = 'purchase' AND deleted_at = 0 AND CAST(json_extract(payload, '$.k') AS BIGINT) >= 10")
def count_live_items(d: Domain) -> DataFrame:
    k = F.get_json_object("payload", "$.k").try_cast("bigint")
    return d.changes.where((F.col("kind") == "purchase") & (F.col("deleted_at") == 0) & (k >= 10)).agg(F.count(F.lit(1)).alias("n"))


@query("changes_since", "SELECT kind, id, rev, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM changes WHERE rev > 500")
def changes_since(d: Domain) -> DataFrame:
    return decode(d.changes.where("rev > 500"), "k bigint").select("kind", "id", "rev", "record.k")


@query("blob_dedupe", "SELECT sha256(text) AS id, min(doc_id) AS doc_id, CAST(min(strlen(text)) AS BIGINT) AS byte_size FROM documents GROUP BY 1", plain=True)
def blob_dedupe(d: Domain) -> DataFrame:
    return store.put(d.blobs, "id", ("doc_id",)).select("id", "doc_id", "byte_size")


@query("blob_paths", "SELECT doc_id, substr(sha256(text),1,2) || '/' || substr(sha256(text),3,2) || '/' || sha256(text) AS path FROM documents", plain=True)
def blob_paths(d: Domain) -> DataFrame:
    return d.blobs.select("doc_id", store.shard_path(F.col("id")).alias("path"))


@query("log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500", plain=True)
def log_tail(d: Domain) -> DataFrame:
    return store.log_tail(d.table("events")).select("event_id", "event_type")


@query("share_line", "SELECT id, concat_ws(' · ', merchant, purchased_at, CAST(total AS VARCHAR)) AS line FROM live")
def share_line(d: Domain) -> DataFrame:
    return d.live.select("id", display.share_line(F.col("merchant"), F.col("purchased_at"), F.col("total").cast("string")).alias("line"))


def _receipts(d: Domain, spec: ReceiptFilter) -> DataFrame:
    return filters.receipts_where(d.receipts, spec, d.receipt_tags, d.items).select("id", "purchased_at", _money(), "status")


def _selected(where: str, extra: str = "") -> str:
    return f"SELECT id, purchased_at, CAST(total AS DOUBLE) AS total, status FROM live r WHERE {where}{extra}"


@query("receipts_by_status", _selected("status IN ('failed', 'parsed')"))
def receipts_by_status(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(statuses=("failed", "parsed")))


@query("receipts_by_category", _selected("category_id IN ('1-URGENT', '5-LOW')"))
def receipts_by_category(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(categories=("1-URGENT", "5-LOW")))


@query("receipts_all_tags", _selected("id IN (SELECT receipt_id FROM receipt_tags WHERE tag_id IN ('Brand#11', 'Brand#12') GROUP BY 1 HAVING count(*) = 2)"))
def receipts_all_tags(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(tags=("Brand#11", "Brand#12")))


@query("receipts_date_range", _selected("purchased_at BETWEEN '1996-02-01' AND '1996-04-30'"))
def receipts_date_range(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(date_from="1996-02-01", date_to="1996-04-30"))


@query("receipts_total_range", _selected("coalesce(total, 0) BETWEEN 1000 AND 20000"))
def receipts_total_range(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(total_min=1000.0, total_max=20000.0))


@query("needs_review", _selected("CASE status WHEN 'failed' THEN true WHEN 'confirmed' THEN false ELSE warned END"))
def needs_review(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(review=True))


@query("receipt_search", _selected("(lower(concat_ws(' ', merchant, city)) LIKE '%77%' AND lower(concat_ws(' ', merchant, city)) LIKE '%nation 7%' OR lower(concat_ws(' ', merchant, city)) LIKE '%77%' AND lower(concat_ws(' ', merchant, city)) LIKE '%gear%') OR id IN (SELECT receipt_id FROM items WHERE search_name LIKE '%77%' OR search_name LIKE '%red gear%')"))
def receipt_search(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(query='77 "red gear"'))


@query("this_month", _selected("purchased_at BETWEEN '1997-05-01' AND '1997-05-20'"))
def this_month(d: Domain) -> DataFrame:
    return _receipts(d, ReceiptFilter(date_from="1997-05-01", date_to="1997-05-20"))


def _purchases(d: Domain, spec: PurchaseFilter = PurchaseFilter()) -> DataFrame:  # noqa: B008
    return filters.purchases(d.items, d.receipts, spec).select("receipt_id", "line_no", "part_id", "name", _price(), "merchant", "purchased_at")


_BOUGHT = "SELECT receipt_id, line_no, part_id, name, CAST(total_price AS DOUBLE) AS total_price, merchant, purchased_at FROM bought"


@query("purchases", _BOUGHT)
def purchases(d: Domain) -> DataFrame:
    return _purchases(d)


@query("purchases_price_range", _BOUGHT + " WHERE total_price BETWEEN 100 AND 5000")
def purchases_price_range(d: Domain) -> DataFrame:
    return _purchases(d, PurchaseFilter(price_min=100.0, price_max=5000.0))


@query("purchases_by_merchant", _BOUGHT + " WHERE lower(merchant) IN ('customer#000000007', 'customer#000000011', 'customer#7', 'customer#11')")
def purchases_by_merchant(d: Domain) -> DataFrame:
    return _purchases(d, PurchaseFilter(merchants=("Customer#000000007", "Customer#000000011", "Customer#7", "Customer#11")))


@query("purchase_search", _BOUGHT + " WHERE search_name || ' ' || lower(merchant) LIKE '%e%' AND search_name || ' ' || lower(merchant) LIKE '%11%'")
def purchase_search(d: Domain) -> DataFrame:
    return _purchases(d, PurchaseFilter(query="e 11"))


@query("purchases_with_discounts", "SELECT receipt_id, line_no, part_id, CAST(total_price AS DOUBLE) AS total_price FROM items i JOIN live r ON i.receipt_id = r.id")
def purchases_with_discounts(d: Domain) -> DataFrame:
    return _purchases(d, PurchaseFilter(discounts=True, deposits=True)).select("receipt_id", "line_no", "part_id", "total_price")


@query("scope_filter", "SELECT DISTINCT category_id AS id FROM items WHERE category_id NOT LIKE 'STANDARD%'")
def scope_filter(d: Domain) -> DataFrame:
    return d.items.where(~F.col("category_id").startswith("STANDARD")).select(F.col("category_id").alias("id")).distinct()


@query("receipts_sorted", "SELECT id, row_number() OVER (ORDER BY total DESC, id) AS place FROM live")
def receipts_sorted(d: Domain) -> DataFrame:
    return placed(d.live.select("id", "total"), filters.receipt_order("total", True)).select("id", "place")


@query("receipts_by_date", "SELECT id, row_number() OVER (ORDER BY purchased_at DESC, id) AS place FROM live")
def receipts_by_date(d: Domain) -> DataFrame:
    return placed(d.live.select("id", "purchased_at", "updated_at"), filters.receipt_order("date", True)).select("id", "place")


@query("receipts_by_added", "SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM live")
def receipts_by_added(d: Domain) -> DataFrame:
    return placed(d.live.select("id", "updated_at"), filters.receipt_order("added", True)).select("id", "place")


@query("receipts_by_items", "SELECT id, row_number() OVER (ORDER BY n, id) AS place FROM (SELECT id, (SELECT count(*) FROM items WHERE receipt_id = id) AS n FROM live)")
def receipts_by_items(d: Domain) -> DataFrame:
    counts = d.items.groupBy(F.col("receipt_id").alias("id")).agg(F.count(F.lit(1)).alias("item_count"))
    return placed(d.live.select("id").join(counts, "id", "left"), filters.receipt_order("items", False)).select("id", "place")


@query("receipts_by_merchant", "SELECT id, row_number() OVER (ORDER BY coalesce(merchant, ''), id) AS place FROM live")
def receipts_by_merchant(d: Domain) -> DataFrame:
    """Customers' names have one form, so that their order by letters is the collation's."""
    return placed(d.live.select("id", "merchant"), filters.receipt_order("merchant", False)).select("id", "place")


@query("purchases_by_quantity", "SELECT receipt_id, line_no, part_id, row_number() OVER (ORDER BY quantity DESC, receipt_id, line_no, part_id, total_price) AS place FROM bought")
def purchases_by_quantity(d: Domain) -> DataFrame:
    rows = filters.purchases(d.items, d.receipts).select("receipt_id", "line_no", "part_id", "total_price", "quantity")
    return placed(rows, filters.purchase_order("quantity", True)).select("receipt_id", "line_no", "part_id", "place")


@query("purchases_sorted", "SELECT receipt_id, line_no, part_id, row_number() OVER (ORDER BY purchased_at, line_no, receipt_id, part_id, total_price) AS place FROM bought")
def purchases_sorted(d: Domain) -> DataFrame:
    order = filters.purchase_order("date", False)
    rows = placed(filters.purchases(d.items, d.receipts).select("receipt_id", "line_no", "part_id", "total_price", "purchased_at", "search_name"), order)
    return rows.select("receipt_id", "line_no", "part_id", "place")


@query("purchases_page", "SELECT receipt_id, line_no, part_id, CAST(total_price AS DOUBLE) AS total_price FROM bought ORDER BY bought.total_price DESC, receipt_id, line_no, part_id LIMIT 450")
def purchases_page(d: Domain) -> DataFrame:
    return filters.page(filters.purchases(d.items, d.receipts), filters.purchase_order("price", True), 3).select("receipt_id", "line_no", "part_id", _price())


@query(
    "receipt_bundle",
    """, one AS (SELECT * FROM receipts WHERE id = 11)
SELECT one.id, CAST(one.total AS DOUBLE) AS total, (SELECT count(*) FROM items WHERE receipt_id = 11) AS n_items,
  (SELECT string_agg(DISTINCT tag_id, ',' ORDER BY tag_id) FROM receipt_tags WHERE receipt_id = 11 AND tag_id NOT LIKE '%5') AS tags,
  CASE WHEN company_id % 4 <> 0 THEN 'Company ' || company_id END AS company FROM one""",
)
def receipt_bundle(d: Domain) -> DataFrame:
    tags = d.receipt_tags.select(F.col("tag_id").alias("id")).distinct().select("id", F.col("id").alias("name"), F.when(F.col("id").endswith("5"), 1).otherwise(0).alias("deleted_at"))
    key = F.col("c_custkey")
    companies = d.table("customer").select(key.alias("id"), F.concat(F.lit("Company "), key.cast("string")).alias("name"), F.when(key % 4 == 0, 1).otherwise(0).alias("deleted_at"))
    b = store.bundle(d.receipts, d.items, d.receipt_tags, tags, companies, 11)
    return b.select("id", _money(), F.size("items").cast("bigint").alias("n_items"), F.array_join("tags", ",").alias("tags"), "company")


@query("tags_by_receipt", "SELECT receipt_id, string_agg(tag_id, ',' ORDER BY tag_id) AS tags FROM receipt_tags GROUP BY 1")
def tags_by_receipt(d: Domain) -> DataFrame:
    return d.receipt_tags.groupBy("receipt_id").agg(F.array_join(F.array_sort(F.collect_list("tag_id")), ",").alias("tags"))


@query("tag_counts", "SELECT tag_id, count(*) AS n FROM receipt_tags GROUP BY 1")
def tag_counts(d: Domain) -> DataFrame:
    return d.receipt_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set_tags_diff",
    """, wanted AS (SELECT DISTINCT receipt_id, 'Brand#' || (10 + receipt_id % 30) AS tag_id FROM items ),
have AS (SELECT receipt_id, tag_id, CASE WHEN receipt_id % 5 = 0 THEN 1 ELSE 0 END AS deleted_at FROM receipt_tags)
SELECT * FROM (SELECT coalesce(w.receipt_id, h.receipt_id) AS receipt_id, coalesce(w.tag_id, h.tag_id) AS tag_id,
  CASE WHEN w.tag_id IS NOT NULL AND h.tag_id IS NULL THEN 'add' WHEN w.tag_id IS NOT NULL AND h.deleted_at <> 0 THEN 'revive'
       WHEN w.tag_id IS NOT NULL THEN 'keep' WHEN h.deleted_at = 0 THEN 'remove' END AS action
FROM wanted w FULL JOIN have h ON w.receipt_id = h.receipt_id AND w.tag_id = h.tag_id) WHERE action IS NOT NULL""",
)
def set_tags_diff(d: Domain) -> DataFrame:
    wanted = d.items.select("receipt_id", F.concat(F.lit("Brand#"), (10 + F.col("receipt_id") % 30).cast("string")).alias("tag_id")).distinct()
    have = d.receipt_tags.withColumn("deleted_at", F.when(F.col("receipt_id") % 5 == 0, 1).otherwise(0))
    return store.tag_changes(wanted, have)


def _references(d: Domain) -> DataFrame:
    """Documents stand for blobs; pages, labels and conversations refer to them by number."""
    ids = d.table("labels").select((F.col("doc_id") + 0).alias("a"), (F.col("doc_id") + 1).alias("b"), F.when(F.col("quality") == 1, F.col("doc_id") + 2).alias("c"))
    return store.referenced(ids, ("a", "b", "c"))


_REFS = "refs AS (SELECT doc_id AS id FROM labels UNION SELECT doc_id + 1 FROM labels UNION SELECT doc_id + 2 FROM labels WHERE quality = 1)"


@query("blob_gc", f"WITH {_REFS} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM refs)", plain=True)
def blob_gc(d: Domain) -> DataFrame:
    return store.unreferenced(d.table("documents").select(F.col("doc_id").alias("id")), _references(d))


@query("blob_status", f"WITH {_REFS} SELECT id, id IN (SELECT doc_id FROM documents) AS present FROM refs", plain=True)
def blob_status(d: Domain) -> DataFrame:
    return store.status(_references(d), d.table("documents").select(F.col("doc_id").alias("id")))


@query("missing_blobs", f"WITH {_REFS} SELECT id FROM refs WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) ORDER BY id LIMIT 12", plain=True)
def missing_blobs(d: Domain) -> DataFrame:
    return store.missing(_references(d), d.table("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")), 12)


@query("blob_size", "SELECT count(*) AS blobs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents", plain=True)
def blob_size(d: Domain) -> DataFrame:
    return store.size(d.blobs)


@query("orphan_companies", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)", plain=True)
def orphan_companies(d: Domain) -> DataFrame:
    return store.unreferenced(d.table("customer").select(F.col("c_custkey").alias("id")), store.referenced(d.table("orders").where("o_orderstatus = 'P' and o_totalprice > 200000"), ("o_custkey",)))


@query(
    "restore_receipt",
    """SELECT i.receipt_id, i.line_no, i.part_id FROM items i JOIN receipts r ON i.receipt_id = r.id
WHERE r.deleted_at = 1 AND i.line_no % 2 = 1""",
)
def restore_receipt(d: Domain) -> DataFrame:
    items = d.items.withColumn("deleted_at", (F.col("line_no") % 2).cast("bigint"))
    return store.restore(items, d.receipts).select("receipt_id", "line_no", "part_id")


@query("delete_category", "SELECT id, CASE WHEN category_id <> '3-MEDIUM' THEN category_id END AS category_id FROM live")
def delete_category(d: Domain) -> DataFrame:
    return store.without_category(d.live, "3-MEDIUM").select("id", "category_id")


@query("purgeable", "SELECT rev FROM changes WHERE deleted_at > 0 AND deleted_at < 1706745600000 - CAST(15 AS BIGINT) * 86400000 AND rev % 2 = 0")
def purgeable(d: Domain) -> DataFrame:
    return store.purgeable(d.changes.withColumn("dirty", F.col("rev") % 2), 1706745600000, 15).select("rev")


@query("discardable_originals", "SELECT id, CAST(id % 11 AS VARCHAR) AS blob_id FROM receipts WHERE status IN ('parsed', 'confirmed') AND id % 11 <> id % 5")
def discardable_originals(d: Domain) -> DataFrame:
    mod = lambda n: (F.col("id") % n).cast("string")
    r = d.receipts.select("id", "status", mod(11).alias("original_image_id"), mod(5).alias("image_id"), F.lit(None).cast("string").alias("thumb_id"))
    return store.discardable(r)


@query("known_merchants", "SELECT DISTINCT merchant FROM live WHERE merchant <> ''")
def known_merchants(d: Domain) -> DataFrame:
    return d.live.where("merchant <> ''").select("merchant").distinct().orderBy(F.collate("merchant", "sv"))


@query("item_counts", "SELECT receipt_id, count(*) AS n FROM items GROUP BY 1")
def item_counts(d: Domain) -> DataFrame:
    return d.items.groupBy("receipt_id").agg(F.count(F.lit(1)).alias("n"))


@query("next_line_no", "SELECT r.id, coalesce(max(line_no) + 1, 0) AS line_no FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id GROUP BY 1")
def next_line_no(d: Domain) -> DataFrame:
    most = d.items.groupBy("receipt_id").agg(F.max("line_no").alias("m"))
    return d.receipts.join(most, F.col("id") == F.col("receipt_id"), "left").select("id", F.coalesce(F.col("m") + 1, F.lit(0)).alias("line_no"))
