"""Values as text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the blank that does not break lines, used within amounts.
BLANK = "\u00a0"


def format_money(v: Column, currency: str = "kr") -> Column:
    """`1 234,50 kr`; null is a dash."""
    text = F.translate(F.format_number(v, 2), ",.", f"{BLANK},")
    return F.when(v.isNull(), "–").otherwise(F.concat(text, F.lit(f"{BLANK}{currency}")))


def format_amount(v: Column) -> Column:
    """`1 234,50` for tables, without a currency; null and what is no number are a dash."""
    text = F.translate(F.format_number(v, 2), ",.", f"{BLANK},")
    return F.when(v.isNull() | F.isnan(v.cast("double")), "–").otherwise(text)


def format_quantity(v: Column) -> Column:
    """At most three decimals, without zeros at the end: `1`, `0,412`."""
    text = F.translate(F.format_number(v, 3), ",.", f"{BLANK},")
    return F.regexp_replace(text, ",?0+$", "")


def format_date(at: Column) -> Column:
    """The day of local date text; a dash if there is none."""
    return F.when(F.coalesce(at, F.lit("")) == "", "–").otherwise(F.substring(at, 1, 10))


def format_date_time(at: Column) -> Column:
    """`2024-03-15 09:05`, or the day alone where no time is known."""
    parts = F.split(at, "T")
    time = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.when(F.coalesce(at, F.lit("")) == "", "–").when(time == "", parts[0]).otherwise(F.concat_ws(" ", parts[0], F.substring(time, 1, 5)))


def format_unit(unit: Column) -> Column:
    """A unit as it stands behind a quantity; `other` is left out."""
    return F.when(unit == "other", "").otherwise(unit)


def format_bytes(n: Column) -> Column:
    """Bytes, or kB and MB with one decimal sign."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.floor(n / 1024.0 + 0.5).cast("string"), F.lit(" kB")))
        .otherwise(F.concat(F.replace((F.floor(n * 10 / 1048576.0 + 0.5) / 10).cast("string"), F.lit("."), F.lit(",")), F.lit(" MB")))
    )


def share_line(merchant: Column, day: Column, total: Column) -> Column:
    """One line about a receipt; parts that are missing are left out."""
    return F.concat_ws(" · ", merchant, day, total)
