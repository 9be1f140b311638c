"""Arithmetic and completeness rules over receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What sums may differ by, and the usual rates.
TOLERANCE = 0.51
RATES = (0, 6, 12, 25)
#: Words of deposit lines, and words and parts of words of discount lines.
DEPOSIT_WORDS, DISCOUNT_WORDS = ("pant",), ("rea",)
DISCOUNT_PARTS = (
    "rabatt", "prisnedsättning", "prisnedsattning", "kampanj", "erbjudande", "extrapris", "stammis", "medlemspris", "klubbpris", "avdrag", "prisjustering",
)


def line_class(name: Column, total: Column) -> Column:
    """deposit, discount or product; deposits come first and a negative price is a discount."""
    small = F.lower(name)
    words = F.split(small, "[^a-z0-9_]+")
    among = lambda some: F.arrays_overlap(words, F.array(*[F.lit(w) for w in some]))
    parts = F.exists(F.array(*[F.lit(w) for w in DISCOUNT_PARTS]), lambda w: F.contains(small, w))
    return F.when(among(DEPOSIT_WORDS), "deposit").when(among(DISCOUNT_WORDS) | parts | (total < 0), "discount").otherwise("product")


def line_totals(items: DataFrame) -> DataFrame:
    """For each receipt the sum of all its lines and that of its products."""
    plain = ~F.col("is_discount") & ~F.col("is_deposit")
    return items.groupBy("receipt_id").agg(F.sum("total_price").alias("lines_total"), F.sum(F.when(plain, F.col("total_price")).otherwise(0)).alias("items_total"), F.count(F.lit(1)).alias("n"))


def discrepancy(total: Column, lines: Column, rounding: Column, discount: Column) -> Column:
    return total - (lines + F.coalesce(rounding, F.lit(0)) - F.coalesce(discount, F.lit(0)))


def issues(df: DataFrame, as_of: str) -> DataFrame:
    """One row (id, code, severity) for each broken rule.

    df has id, merchant, purchased_at, total, rounding, discount, lines_total, n_items and vat_lines, an array of
    structs (rate, net, vat, gross).
    """
    gross = F.aggregate(F.coalesce("vat_lines", F.array().cast("array<struct<rate:double,net:double,vat:double,gross:double>>")), F.lit(0.0), lambda s, v: s + F.coalesce(v["gross"], F.lit(0.0)))
    day = F.substring("purchased_at", 1, 10)
    total = F.col("total").cast("double")
    off = discrepancy(total, F.col("lines_total").cast("double"), F.col("rounding").cast("double"), F.col("discount").cast("double"))
    lines = F.coalesce("vat_lines", F.array().cast("array<struct<rate:double,net:double,vat:double,gross:double>>"))
    rules = [
        ("merchant-missing", "warning", F.trim(F.coalesce("merchant", F.lit(""))) == ""),
        ("date-missing", "warning", F.col("purchased_at").isNull()),
        ("date-future", "warning", day > as_of),
        ("total-missing", "error", total.isNull()),
        ("total-negative", "info", total < 0),
        ("items-missing", "warning", F.col("n_items") == 0),
        ("total-mismatch", "warning", (F.col("n_items") > 0) & (F.abs(off) > TOLERANCE)),
        ("vat-mismatch", "warning", (gross > 0) & (F.abs(gross - total) > TOLERANCE)),
        ("vat-rate-unusual", "info", F.exists(lines, lambda v: ~v["rate"].isin(*RATES))),
        ("vat-line-mismatch", "info", F.exists(lines, lambda v: F.coalesce((v["rate"] > 0) & (F.abs(v["net"] * v["rate"] / 100 - v["vat"]) > TOLERANCE), F.lit(False)))),
    ]
    broken = F.filter(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in rules]), lambda x: x.isNotNull())
    return df.select("id", F.explode(broken).alias("i")).select("id", "i.code", "i.severity")


def severities(found: DataFrame) -> DataFrame:
    """Issues of each receipt by severity; ok if all are info."""
    n = lambda s: F.sum((F.col("severity") == s).cast("int")).cast("bigint")
    out = found.groupBy("id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    return out.withColumn("ok", (F.col("errors") == 0) & (F.col("warnings") == 0))


def better(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Whether reading a (errors, warnings, discrepancy) beats b; equal ones do not."""
    s = lambda x: F.struct(x[0].alias("e"), x[1].alias("w"), F.abs(x[2]).alias("d"))
    return s(a) < s(b)


def reconcile(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts whose total differs from their lines, with the difference."""
    sums = line_totals(items).select("receipt_id", "lines_total")
    joined = receipts.join(sums, receipts["id"] == sums["receipt_id"]).select("id", (F.col("total") - F.col("lines_total")).alias("difference"))
    return joined.select("id", F.col("difference").cast("double").alias("difference"), (F.abs("difference") > TOLERANCE).alias("mismatch"))
