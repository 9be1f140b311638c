"""Where queries and the SQL they are held against are written down together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.adapter import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The domain's tables over the driver's, as the adapter reads them.
DOMAIN = """WITH receipts AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS purchased_at, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
         CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'parsed' WHEN 'P' THEN 'failed' END AS status,
         c_name AS merchant, n_name AS city, o_orderpriority AS category_id, o_custkey AS company_id,
         CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS deleted_at, o_orderkey * 10 + o_custkey % 7 AS updated_at,
         o_orderkey % 9 = 0 AS warned, sha256(CAST(o_orderkey AS VARCHAR)) AS image_id
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
live AS (SELECT * FROM receipts WHERE deleted_at = 0),
items AS (
  SELECT l_orderkey AS receipt_id, l_linenumber AS line_no, l_partkey AS part_id, p_name AS name, p_name AS search_name, p_type AS category_id,
         p_brand AS brand, l_quantity AS quantity, l_tax * 100 AS vat_rate,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS total_price,
         l_returnflag = 'R' AS is_discount, l_returnflag = 'A' AND l_linestatus = 'F' AS is_deposit
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
receipt_tags AS (SELECT DISTINCT receipt_id, brand AS tag_id FROM items),
bought AS (
  SELECT i.*, r.merchant, r.purchased_at, r.city, r.category_id AS receipt_category_id
  FROM items i JOIN live r ON i.receipt_id = r.id WHERE NOT is_discount AND NOT is_deposit),
changes AS (
  SELECT event_type AS kind, user_id AS id, epoch_ms(date_trunc('day', ts)) AS updated_at,
         CASE WHEN value < 1 THEN epoch_ms(date_trunc('day', ts)) ELSE 0 END AS deleted_at, event_id + 1 AS rev, props AS payload, value
  FROM events)
"""


def query(name: str, sql: str | None = None, plain: bool = False):
    """Registers a query over the domain. sql goes on from DOMAIN's tables; plain SQL stands for itself."""

    def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            SQL[name] = sql if plain else DOMAIN + sql
        return f

    return add
