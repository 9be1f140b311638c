"""The domain for users of spark.sql: its tables as temporary views, and functions in SQL that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyloom.functions.text import LEGAL_WORDS, MARKED, PLAIN
from tallyloom.sources.adapter import Domain

VIEWS = ("receipts", "live", "items", "receipt_tags", "changes", "blobs")

_WORDS = f"filter(split(fold(name), ' '), w -> w <> '' AND length(w) > 1 AND NOT array_contains(array({', '.join(repr(w) for w in LEGAL_WORDS)}), w))"

#: Name, parameters and body of each function; a body may use those ahead of it.
FUNCTIONS = (
    ("round_money", "v DOUBLE", "DOUBLE", "CASE WHEN v IS NULL THEN NULL WHEN isnan(v) OR abs(v) = double('infinity') THEN 0D ELSE floor((v + 2.220446049250313e-16D) * 100 + 0.5D) / 100 END"),
    ("search_name", "t STRING", "STRING", r"trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' '))"),
    ("fold", "t STRING", "STRING", f"trim(regexp_replace(translate(lower(t), '{MARKED}', '{PLAIN}'), '[^a-z0-9]+', ' '))"),
    ("significant_words", "name STRING", "ARRAY<STRING>", _WORDS),
    ("month_key", "d STRING", "STRING", "substring(d, 1, 7)"),
    ("day_key", "d STRING", "STRING", "substring(d, 1, 10)"),
    ("within_days", "d STRING, as_of STRING, n INT", "BOOLEAN", "datediff(CAST(as_of AS DATE), try_to_date(substring(d, 1, 10), 'yyyy-MM-dd')) <= n"),
    ("unit_price", "total DOUBLE, quantity DOUBLE, discount BOOLEAN", "DOUBLE", "CASE WHEN quantity > 0 AND NOT discount THEN round_money(total / quantity) END"),
    ("needs_review", "status STRING, warnings ARRAY<STRING>", "BOOLEAN", "CASE status WHEN 'failed' THEN true WHEN 'confirmed' THEN false ELSE size(warnings) > 0 END"),
)


def register(spark: SparkSession, sf_dir: str, prefix: str = "") -> SparkSession:
    """Makes the domain's views, and functions named tl_<name>, known to the session; both are temporary."""
    domain = Domain(spark, sf_dir)
    for view in VIEWS:
        getattr(domain, view).createOrReplaceTempView(prefix + view)
    names = [n for n, *_ in FUNCTIONS]
    for name, parameters, returns, body in FUNCTIONS:
        for other in names:
            body = body.replace(f"{other}(", f"tl_{other}(")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tl_{name}({parameters}) RETURNS {returns} RETURN {body}")
    return spark
