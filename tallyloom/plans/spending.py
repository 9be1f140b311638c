"""Queries that add up spending and follow prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import filters, quality, rollups
from tallyloom.plans.registry import query
from tallyloom.sources.adapter import Domain

AS_OF = "1997-05-20"


def _purchases(d: Domain) -> DataFrame:
    return filters.purchases(d.items, d.receipts)


@query(
    "spend_month_category",
    """, t AS (SELECT substr(purchased_at, 1, 7) AS month, category_id, CAST(sum(total_price) AS DOUBLE) AS total, count(*) AS n FROM bought GROUP BY 1, 2)
SELECT month, category_id, total, n, rank() OVER (PARTITION BY month ORDER BY total DESC) AS place FROM t""",
)
def spend_month_category(d: Domain) -> DataFrame:
    """The flagship: purchases by month and category with each category's place in its month."""
    t = _purchases(d).groupBy(F.substring("purchased_at", 1, 7).alias("month"), "category_id").agg(rollups.amount("total_price").alias("total"), F.count(F.lit(1)).alias("n"))
    return t.withColumn("place", F.rank().over(Window.partitionBy("month").orderBy(F.desc("total"))).cast("bigint"))


@query("spend_summary", "SELECT floor(CAST(sum(total) AS DOUBLE) * 100 + 0.5) / 100 AS total, count(*) AS receipts, (SELECT count(*) FROM items WHERE receipt_id IN (SELECT id FROM live)) AS items FROM live")
def spend_summary(d: Domain) -> DataFrame:
    return rollups.summary(d.live, d.items)


@query("spend_by_month", "SELECT coalesce(substr(purchased_at, 1, 7), 'okänt') AS month, CAST(sum(total) AS DOUBLE) AS total, count(*) AS n FROM live GROUP BY 1")
def spend_by_month(d: Domain) -> DataFrame:
    return rollups.by_month(d.live)


@query("spend_by_merchant", "SELECT coalesce(merchant, 'Okänd butik') AS merchant, CAST(sum(total) AS DOUBLE) AS total, count(*) AS n FROM live GROUP BY 1")
def spend_by_merchant(d: Domain) -> DataFrame:
    return rollups.by_merchant(d.live)


_BY_CATEGORY = "SELECT category_id, CAST(sum(total_price) AS DOUBLE) AS total, count(*) AS n FROM bought GROUP BY 1"


@query("spend_by_category", _BY_CATEGORY)
def spend_by_category(d: Domain) -> DataFrame:
    return rollups.by_category(_purchases(d))


@query("spend_by_category_named", f", t AS ({_BY_CATEGORY}) SELECT category_id, total, n, CASE WHEN category_id LIKE '%A%' THEN lower(category_id) ELSE 'Övrigt' END AS name FROM t")
def spend_by_category_named(d: Domain) -> DataFrame:
    c = F.col("p_type")
    names = d.table("part").where(F.contains(c, F.lit("A"))).select(c.alias("id"), F.lower(c).alias("name")).distinct()
    return rollups.named(rollups.by_category(_purchases(d)), names)


@query("top_categories", f", t AS ({_BY_CATEGORY}) SELECT category_id, total FROM t WHERE total > 0 ORDER BY total DESC, category_id LIMIT 10")
def top_categories(d: Domain) -> DataFrame:
    return rollups.top(rollups.by_category(_purchases(d)), "total", "category_id", 10, positive=True).select("category_id", "total")


_MTD = f"SELECT category_id, CAST(sum(total) AS DOUBLE) AS amount FROM live WHERE purchased_at BETWEEN '1997-05-01' AND '{AS_OF}' GROUP BY 1 ORDER BY amount DESC, category_id LIMIT 4"


def _mtd(d: Domain) -> DataFrame:
    groups = rollups.month_to_date(d.live, AS_OF).groupBy("category_id").agg(rollups.amount("total").alias("amount"))
    return rollups.top(groups, "amount", "category_id", 4)


@query("mtd_by_category", _MTD)
def mtd_by_category(d: Domain) -> DataFrame:
    return _mtd(d)


@query("mtd_vs_prev", f""", s AS (SELECT CAST(sum(CASE WHEN purchased_at BETWEEN '1997-05-01' AND '{AS_OF}' THEN total ELSE 0 END) AS DOUBLE) AS current,
  CAST(sum(CASE WHEN purchased_at BETWEEN '1997-04-01' AND '1997-04-20' THEN total ELSE 0 END) AS DOUBLE) AS previous FROM live)
SELECT current, previous, abs(current - previous) AS difference, current >= previous AS more FROM s""")
def mtd_vs_prev(d: Domain) -> DataFrame:
    return rollups.compared(d.live, AS_OF)


@query("category_cum_share", f""", t AS ({_BY_CATEGORY})
SELECT category_id, row_number() OVER w AS rank, round(total / sum(total) OVER () * 100, 6) AS share, round(sum(total) OVER (w ROWS UNBOUNDED PRECEDING) / sum(total) OVER () * 100, 6) AS running
FROM t WINDOW w AS (ORDER BY total DESC, category_id)""")
def category_cum_share(d: Domain) -> DataFrame:
    r = rollups.running_share(rollups.by_category(_purchases(d)), "total", "category_id")
    return r.select("category_id", F.col("rank").cast("bigint").alias("rank"), F.round("share", 6).alias("share"), F.round("running", 6).alias("running"))


@query("month_sections", """, l AS (SELECT id, substr(purchased_at, 1, 7) AS month, CASE status WHEN 'failed' THEN true WHEN 'confirmed' THEN false ELSE warned END AS review FROM live)
SELECT id, month, dense_rank() OVER (ORDER BY month DESC) AS section, sum(CAST(review AS INTEGER)) OVER (PARTITION BY month) AS to_review FROM l""")
def month_sections(d: Domain) -> DataFrame:
    return _sections(d, "date")


@query("month_sections_by_total", """, l AS (SELECT id, total, substr(purchased_at, 1, 7) AS month, CASE status WHEN 'failed' THEN true WHEN 'confirmed' THEN false ELSE warned END AS review FROM live),
t AS (SELECT *, month IS DISTINCT FROM lag(month) OVER (ORDER BY total DESC, id) AS turn FROM l)
SELECT id, month, CAST(sum(CAST(turn AS INTEGER)) OVER (ORDER BY total DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section, sum(CAST(review AS INTEGER)) OVER (PARTITION BY month) AS to_review FROM t""")
def month_sections_by_total(d: Domain) -> DataFrame:
    """A list by total, in which months have many sections."""
    return _sections(d, "total")


def _sections(d: Domain, by: str) -> DataFrame:
    rows = d.live.select("id", "total", "purchased_at", "updated_at", "status", "warnings")
    s = rollups.sections(rows, filters.receipt_order(by, True), filters.needs_review(F.col("status"), F.col("warnings")))
    return s.select("id", "month", "section", "to_review")


@query("bar_share", f", t AS ({_BY_CATEGORY}) SELECT category_id, round(total / max(total) OVER () * 100, 6) AS bar FROM t")
def bar_share(d: Domain) -> DataFrame:
    return rollups.bar_share(rollups.by_category(_purchases(d)), "total").select("category_id", F.round("bar", 6).alias("bar"))


@query("last_12_months", "SELECT substr(purchased_at, 1, 7) AS month, CAST(sum(total) AS DOUBLE) AS total, count(*) AS n FROM live GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def last_12_months(d: Domain) -> DataFrame:
    return rollups.last_months(rollups.by_month(d.live))


@query("price_history", ", p AS (SELECT min(name) AS name FROM bought) SELECT receipt_id, line_no, part_id, purchased_at, CAST(total_price AS DOUBLE) AS total_price FROM bought WHERE search_name = (SELECT name FROM p)")
def price_history(d: Domain) -> DataFrame:
    """Every purchase of one product, oldest first: the one whose name sorts first."""
    p = _purchases(d)
    first = p.agg(F.min("search_name").alias("search_name"))  # one row
    return p.join(F.broadcast(first), "search_name").orderBy(*filters.purchase_order("date", False)).select("receipt_id", "line_no", "part_id", "purchased_at", F.col("total_price").cast("double").alias("total_price"))


@query("price_trend", """, p AS (SELECT search_name, CAST(total_price AS DOUBLE) / greatest(quantity, 1) AS price, row(purchased_at, receipt_id, line_no, part_id, CAST(total_price AS DOUBLE) / greatest(quantity, 1)) AS k FROM bought),
r AS (SELECT *, row_number() OVER (PARTITION BY search_name ORDER BY k) AS a, row_number() OVER (PARTITION BY search_name ORDER BY k DESC) AS z FROM p),
g AS (SELECT search_name, max(CASE WHEN a = 1 THEN price END) AS first, max(CASE WHEN z = 1 THEN price END) AS last, round(avg(price), 6) AS average, count(*) AS n, greatest(max(CASE WHEN z <= 9 THEN price END), 1) AS highest FROM r GROUP BY 1)
SELECT search_name, first, last, average, n, highest, CASE WHEN first = 0 THEN 0.0 ELSE floor((last - first) / first * 100 + 0.5) END AS change FROM g""")
def price_trend(d: Domain) -> DataFrame:
    return rollups.price_trend(_purchases(d)).withColumn("average", F.round("average", 6))


@query("best_candidate", "SELECT search_name, CAST(total_price AS DOUBLE) AS total_price, receipt_id, line_no, part_id FROM (SELECT *, row_number() OVER (PARTITION BY search_name ORDER BY bought.total_price DESC, receipt_id, line_no, part_id) AS r FROM bought) WHERE r = 1")
def best_candidate(d: Domain) -> DataFrame:
    best = rollups.best_of_key(_purchases(d), "search_name", F.col("total_price"), [F.col("receipt_id"), F.col("line_no"), F.col("part_id")])
    return best.select("search_name", F.col("total_price").cast("double").alias("total_price"), "receipt_id", "line_no", "part_id")


@query("line_totals", "SELECT receipt_id, CAST(sum(total_price) AS DOUBLE) AS lines_total, CAST(sum(CASE WHEN NOT is_discount AND NOT is_deposit THEN total_price ELSE 0 END) AS DOUBLE) AS items_total, count(*) AS n FROM items GROUP BY 1")
def line_totals(d: Domain) -> DataFrame:
    t = quality.line_totals(d.items)
    return t.select("receipt_id", F.col("lines_total").cast("double").alias("lines_total"), F.col("items_total").cast("double").alias("items_total"), "n")


@query("vat_gross", "SELECT receipt_id, CAST(sum(total_price) AS DOUBLE) AS gross FROM items GROUP BY 1")
def vat_gross(d: Domain) -> DataFrame:
    """The gross sum of each receipt's VAT lines, held as an array."""
    arrays = d.items.groupBy("receipt_id").agg(F.collect_list(F.struct("vat_rate", F.col("total_price").alias("gross"))).alias("vat_lines"))
    zero = F.lit(0).cast("decimal(28,4)")
    total = F.aggregate("vat_lines", zero, lambda s, v: (s + F.coalesce(v["gross"], F.lit(0).cast("decimal(18,4)"))).cast("decimal(28,4)"))
    return arrays.select("receipt_id", total.cast("double").alias("gross"))


@query("deposit_total", "SELECT receipt_id, CAST(nullif(sum(CASE WHEN is_deposit THEN total_price ELSE 0 END), 0) AS DOUBLE) AS deposit FROM items GROUP BY 1")
def deposit_total(d: Domain) -> DataFrame:
    s = F.sum(F.when(F.col("is_deposit"), F.col("total_price")).otherwise(0))
    return d.items.groupBy("receipt_id").agg(F.nullif(s, F.lit(0)).cast("double").alias("deposit"))


@query("reconcile", """, s AS (SELECT receipt_id, sum(total_price) AS lines_total FROM items GROUP BY 1)
SELECT id, CAST(total - lines_total AS DOUBLE) AS difference, abs(total - lines_total) > 0.51 AS mismatch FROM live JOIN s ON id = receipt_id""")
def reconcile(d: Domain) -> DataFrame:
    return quality.reconcile(d.live, d.items)


_CHECKED = """, s AS (SELECT receipt_id, sum(total_price) AS lines_total, count(*) AS n_items FROM items GROUP BY 1),
v AS (SELECT receipt_id, round(l_tax * 100, 2) AS rate, CAST(sum(total_price) AS DOUBLE) AS net FROM (SELECT *, vat_rate / 100 AS l_tax FROM items) GROUP BY 1, 2),
g AS (SELECT receipt_id, sum(net + net * rate / 100 + CASE WHEN receipt_id % 29 = 0 THEN 2.0 ELSE 0 END) AS gross, bool_or(rate > 0) AS taxed FROM v GROUP BY 1),
c AS (SELECT id, gross, taxed, CASE WHEN id % 31 = 0 THEN CAST(total AS DOUBLE) - CAST(lines_total AS DOUBLE) END AS rounding, CASE WHEN id % 37 = 0 THEN CAST(lines_total AS DOUBLE) - CAST(total AS DOUBLE) END AS discount,
  CASE WHEN id % 13 <> 0 THEN merchant END AS merchant, CASE WHEN id % 17 <> 0 THEN purchased_at END AS purchased_at,
  CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN -CAST(total AS DOUBLE) ELSE CAST(total AS DOUBLE) END AS total, CAST(lines_total AS DOUBLE) AS lines_total, coalesce(n_items, 0) AS n_items,
  EXISTS (SELECT 1 FROM v WHERE v.receipt_id = id AND rate NOT IN (0, 6, 12, 25)) AS odd FROM live LEFT JOIN s ON id = s.receipt_id LEFT JOIN g ON id = g.receipt_id),
found AS (
SELECT id, 'merchant-missing' AS code, 'warning' AS severity FROM c WHERE merchant IS NULL
UNION ALL SELECT id, 'date-missing', 'warning' FROM c WHERE purchased_at IS NULL
UNION ALL SELECT id, 'date-future', 'warning' FROM c WHERE purchased_at > '2000-01-01'
UNION ALL SELECT id, 'total-missing', 'error' FROM c WHERE total IS NULL
UNION ALL SELECT id, 'total-negative', 'info' FROM c WHERE total < 0
UNION ALL SELECT id, 'items-missing', 'warning' FROM c WHERE n_items = 0
UNION ALL SELECT id, 'total-mismatch', 'warning' FROM c WHERE n_items > 0 AND abs(total - (lines_total + coalesce(rounding, 0) - coalesce(discount, 0))) > 0.51
UNION ALL SELECT id, 'vat-mismatch', 'warning' FROM c WHERE gross > 0 AND abs(gross - total) > 0.51
UNION ALL SELECT id, 'vat-line-mismatch', 'info' FROM c WHERE taxed AND id % 29 = 0
UNION ALL SELECT id, 'vat-rate-unusual', 'info' FROM c WHERE odd)
"""


def _issues(d: Domain) -> DataFrame:
    i = F.col("id")
    sums = quality.line_totals(d.items).select("receipt_id", "lines_total", F.col("n").alias("n_items"))
    by_rate = d.items.groupBy("receipt_id", F.round("vat_rate", 2).alias("rate")).agg(F.sum("total_price").cast("double").alias("net"))
    vat = by_rate.withColumn("vat", F.col("net") * F.col("rate") / 100 + F.when(F.col("receipt_id") % 29 == 0, 2.0).otherwise(0.0))
    vat = vat.groupBy("receipt_id").agg(F.collect_list(F.struct("rate", "net", "vat", (F.col("net") + F.col("vat")).alias("gross"))).alias("vat_lines"))
    raw, sold = F.col("total").cast("double"), F.col("lines_total").cast("double")
    total = F.col("total").cast("double")
    df = d.live.join(sums, i == F.col("receipt_id"), "left").drop("receipt_id").join(vat, i == F.col("receipt_id"), "left").select(
        "id", F.when(i % 13 != 0, F.col("merchant")).alias("merchant"), F.when(i % 17 != 0, F.col("purchased_at")).alias("purchased_at"),
        F.when(i % 19 == 0, None).when(i % 23 == 0, -total).otherwise(total).alias("total"), F.when(i % 31 == 0, raw - sold).alias("rounding"), F.when(i % 37 == 0, sold - raw).alias("discount"),
        F.col("lines_total").cast("double").alias("lines_total"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "vat_lines",
    )
    return quality.issues(df, "2000-01-01")


@query("validate", _CHECKED + "SELECT id, code, severity FROM found")
def validate(d: Domain) -> DataFrame:
    return _issues(d)


@query("severity_counts", _CHECKED + "SELECT id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity <> 'info') = 0 AS ok FROM found GROUP BY 1")
def severity_counts(d: Domain) -> DataFrame:
    return quality.severities(_issues(d))


@query("better_reading", """SELECT a.id, (a.id % 2, a.id % 3, abs(CAST(a.total AS DOUBLE) - 100000)) < (b.id % 2, b.id % 3, abs(CAST(b.total AS DOUBLE) - 100000)) AS better FROM receipts a JOIN receipts b ON b.id = a.id + 1""")
def better_reading(d: Domain) -> DataFrame:
    key = lambda p: (F.col(f"{p}.id") % 2, F.col(f"{p}.id") % 3, F.col(f"{p}.total").cast("double") - 100000)
    return d.receipts.alias("a").join(d.receipts.alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), quality.better(key("a"), key("b")).alias("better"))
