"""Amounts, quantities and rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.base import let

#: Words that printed amounts carry and that say nothing about their value.
AMOUNT_WORDS = "kr|kronor|sek|eur|euro|usd|nok|dkk|inkl|exkl|moms|st|kg|hg|g|l|dl|cl|m|förp"
#: Printed units and the unit each stands for.
UNITS = {
    "st": "st", "styck": "st", "stk": "st", "x": "st", "kg": "kg", "kilo": "kg", "hg": "hg", "g": "g", "gram": "g",
    "l": "l", "liter": "l", "dl": "dl", "cl": "cl", "m": "m", "meter": "m", "förp": "förp", "frp": "förp", "pkt": "förp", "paket": "förp",
}

#: Fixed value: the step from 1 to the next double.
STEP = 2.0**-52


def round_half_up(v: Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity; null stays null and what is not finite becomes 0.

    A double's smallest step at 1 is added first, so that 1.005, which is stored a little short, becomes 1.01.
    """
    f = 10.0**digits
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(v.isNull(), None).when(finite, F.floor((v + STEP) * f + 0.5) / f).otherwise(0.0)


def parse_amount(text: Column, grouping: bool = True, digits: int = 2) -> Column:
    """A printed amount as a double: trailing or leading minus, brackets, `:-`, either decimal sign; null if none.

    The last of two different separators is the decimal one; a separator used twice groups; and a lone one before
    three digits groups if grouping is allowed.
    """
    t = F.regexp_replace(text, "[−–—]", "-")
    t = F.trim(F.regexp_replace(t, rf"(?i)(?<![A-Za-z0-9_])(?:{AMOUNT_WORDS})\.?(?![A-Za-z0-9_])", " "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r":\s*-\s*$", ""), r":\s*$", ""))

    def signed(t: Column) -> Column:
        bracketed = t.rlike(r"^\(.*\)$")
        inner = F.when(bracketed, F.regexp_extract(t, r"^\((.*)\)$", 1)).otherwise(t)
        # a minus behind and one in front cancel out
        return let(inner, lambda i: F.struct(((bracketed | i.endswith("-")) != F.regexp_replace(i, "-$", "").startswith("-")).alias("negative"), F.regexp_replace(i, "[^0-9.,]", "").alias("text")))

    def number(p: Column) -> Column:
        t = p["text"]
        comma, dot = F.length(t) - F.length(F.replace(t, F.lit(","))), F.length(t) - F.length(F.replace(t, F.lit(".")))
        grouped = t.rlike(r"^[1-9]\d{0,2}[.,]\d{3}$") & F.lit(grouping)
        last_comma = F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t))
        by_comma, by_dot = F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit(".")), F.replace(t, F.lit(","))
        plain = (
            F.when((comma > 0) & (dot > 0), F.when(last_comma, by_comma).otherwise(by_dot))
            .when((comma > 1) | (dot > 1) | grouped, F.regexp_replace(t, "[.,]", ""))
            .when(comma == 1, by_comma)
            .otherwise(t)
        )
        # what follows a second decimal sign is not read
        value = F.regexp_extract(plain, r"^(\d*\.?\d*)", 1).try_cast("double")
        return let(F.when(p["negative"], -value).otherwise(value), lambda v: F.when(t.rlike(r"\d"), round_half_up(v, digits)))

    return let(let(t, signed), number)


def parse_quantity(text: Column) -> Column:
    """Struct (quantity, unit) of a printed quantity; one piece if it says nothing."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    part = lambda t, n: F.regexp_extract(t, r"^([\d\s .,]+)\s*([a-zåäö]*)", n)

    def read(t: Column) -> Column:
        amount = let(parse_amount(part(t, 1), grouping=False, digits=3), lambda a: F.when(F.coalesce(a, F.lit(0.0)) == 0, 1.0).otherwise(F.abs(a)))
        unit = let(part(t, 2), lambda u: F.when(u == "", "st").otherwise(F.coalesce(F.try_element_at(known, u), F.lit("other"))))
        return F.struct(amount.alias("quantity"), unit.alias("unit"))

    return let(t, read)


def vat_rate(v: Column) -> Column:
    """A rate in percent from a share or a percentage; null if over 100."""
    a = F.abs(v)
    p = F.when(a < 1, a * 100).otherwise(a)
    return F.when(p <= 100, round_half_up(p))


def unit_price(unit: Column, total: Column, quantity: Column, discount: Column) -> Column:
    """The printed price of a unit, or total over quantity for lines that are no discount."""
    return F.coalesce(unit, F.when((quantity > 0) & ~discount, round_half_up(total / quantity)))


def gross(printed: Column, net: Column, vat: Column) -> Column:
    return F.coalesce(printed, round_half_up(net + vat))


def backoff_ceiling(attempt: Column, base: float = 30_000.0, most: float = 1_800_000.0) -> Column:
    """Longest wait before the next try, doubling up to most; the wait itself is drawn below it."""
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
