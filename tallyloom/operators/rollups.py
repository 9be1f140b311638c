"""Spending by month, merchant and category; trends, shares and sections."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.dates import month_key
from tallyloom.functions.money import round_half_up
from tallyloom.operators.filters import dated
from tallyloom.operators.order import islands

UNKNOWN_MONTH, UNKNOWN_SHOP, OTHER = "okänt", "Okänd butik", "Övrigt"


def amount(c: str | Column) -> Column:
    """A sum of decimals as a double; exact until then."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def summary(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """One row: total, receipts and items, discounts and deposits among them. Currencies are added up as they are."""
    lines = items.join(receipts.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi").agg(F.count(F.lit(1)).alias("items"))
    money = receipts.agg(round_half_up(amount("total")).alias("total"), F.count(F.lit(1)).alias("receipts"))
    return money.crossJoin(lines)  # one row each


def by_month(receipts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Total and count for each month; extra columns, such as a currency, split it further."""
    month = F.coalesce(month_key(F.col("purchased_at")), F.lit(UNKNOWN_MONTH)).alias("month")
    return receipts.groupBy(month, *extra).agg(amount("total").alias("total"), F.count(F.lit(1)).alias("n"))


def by_merchant(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy(F.coalesce("merchant", F.lit(UNKNOWN_SHOP)).alias("merchant")).agg(amount("total").alias("total"), F.count(F.lit(1)).alias("n"))


def by_category(purchases: DataFrame) -> DataFrame:
    """Total of lines by category; lines without one are a group of their own."""
    return purchases.groupBy("category_id").agg(amount("total_price").alias("total"), F.count(F.lit(1)).alias("n"))


def named(totals: DataFrame, categories: DataFrame) -> DataFrame:
    return totals.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left").withColumn("name", F.coalesce("name", F.lit(OTHER)))


def month_to_date(receipts: DataFrame, as_of: str) -> DataFrame:
    return dated(receipts, as_of[:8] + "01", as_of)


def compared(receipts: DataFrame, as_of: str) -> DataFrame:
    """Spending of the month so far, of the month before up to the same day, and what lies between. Only receipts of
    the two months are read."""
    first = date.fromisoformat(as_of).replace(day=1)
    receipts = dated(receipts, (first - timedelta(days=1)).replace(day=1).isoformat(), as_of)
    day = F.substring("purchased_at", 1, 10)
    end = F.lit(as_of).cast("date")
    start = F.date_format(F.add_months(F.trunc(end, "month"), -1), "yyyy-MM-dd")
    until = F.date_format(F.add_months(end, -1), "yyyy-MM-dd")  # clamped to the month's length
    now = F.sum(F.when(day.between(as_of[:8] + "01", as_of), F.col("total")).otherwise(0)).cast("double")
    then = F.sum(F.when(day.between(start, until), F.col("total")).otherwise(0)).cast("double")
    return receipts.agg(F.coalesce(now, F.lit(0.0)).alias("current"), F.coalesce(then, F.lit(0.0)).alias("previous")).withColumn("difference", F.abs(F.col("current") - F.col("previous"))).withColumn("more", F.col("current") >= F.col("previous"))


def top(df: DataFrame, value: str, key: str, n: int, positive: bool = False) -> DataFrame:
    df = df.where(F.col(value) > 0) if positive else df
    return df.orderBy(F.col(value).desc(), F.col(key).asc_nulls_first()).limit(n)


def running_share(groups: DataFrame, value: str, key: str) -> DataFrame:
    """Each group's share of all and the running share, largest first. groups is small: one row for each category."""
    w = Window.orderBy(F.col(value).desc(), F.col(key).asc_nulls_first())
    total = F.sum(value).over(Window.partitionBy())
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("rank", F.row_number().over(w)).withColumn("share", F.when(total > 0, F.col(value) / total * 100).otherwise(100.0)).withColumn("running", F.when(total > 0, run / total * 100).otherwise(100.0))


def bar_share(groups: DataFrame, value: str) -> DataFrame:
    return groups.withColumn("bar", F.col(value) / F.max(value).over(Window.partitionBy()) * 100)


def last_months(months: DataFrame, n: int = 12) -> DataFrame:
    """The latest n months, if there are two or more."""
    w = Window.orderBy(F.col("month").desc())
    return months.where(F.col("month") != UNKNOWN_MONTH).withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).where((F.col("_r") <= n) & (F.col("_n") >= 2)).drop("_r", "_n")


def sections(receipts: DataFrame, order: list[Column], review: Column) -> DataFrame:
    """Receipts with their month, its section and how many of the list's receipts of that month are to be reviewed.

    A new section begins whenever the month differs from the row before, whatever the order is: in a list by total a
    month has as many sections as it has runs.
    """
    month = F.coalesce(month_key(F.col("purchased_at")), F.lit(UNKNOWN_MONTH))
    df = receipts.withColumn("month", month).withColumn("_review", review.cast("int"))
    heads = df.groupBy("month").agg(F.sum("_review").alias("to_review"))
    return islands(df, order, "month", "section").join(F.broadcast(heads), "month").drop("_review")  # heads: one row a month, at most 12 x the years covered


def price(unit_price: Column, total: Column, quantity: Column) -> Column:
    """Paid for a unit; parts of a unit count as one."""
    return F.coalesce(unit_price, total / F.greatest(quantity, F.lit(1)))


def price_trend(purchases: DataFrame, key: str = "search_name", last: int = 9) -> DataFrame:
    """For each product the first, last and average price, the change in percent, and the highest of the latest."""
    at = F.struct("purchased_at", "receipt_id", "line_no", "part_id", "price")
    rows = purchases.withColumn("price", price(F.lit(None).cast("double"), F.col("total_price").cast("double"), F.col("quantity")))
    w = Window.partitionBy(key).orderBy(at.desc())
    ranked = rows.select(key, "price", at.alias("at"), F.row_number().over(w).alias("_r"))
    groups = ranked.groupBy(key).agg(
        F.min_by("price", "at").alias("first"), F.max_by("price", "at").alias("last"), F.avg("price").alias("average"), F.count(F.lit(1)).alias("n"),
        F.greatest(F.max(F.when(F.col("_r") <= last, F.col("price"))), F.lit(1.0)).alias("highest"),
    )
    change = F.when(F.col("first") == 0, 0.0).otherwise(F.floor((F.col("last") - F.col("first")) / F.col("first") * 100 + 0.5).cast("double"))
    return groups.withColumn("change", change)


def best_of_key(df: DataFrame, key: str, score: Column, order: list[Column]) -> DataFrame:
    """The row with the highest score of each key, the first of equal ones."""
    w = Window.partitionBy(key).orderBy(score.desc(), *order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
