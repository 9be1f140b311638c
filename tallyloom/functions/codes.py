"""Organisation and VAT numbers, article and card numbers, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First digit of an organisation number and the legal form that it stands for.
LEGAL_FORMS = {
    "1": "Dödsbo",
    "2": "Stat, region, kommun eller församling",
    "3": "Utländskt företag med verksamhet i Sverige",
    "5": "Aktiebolag",
    "6": "Samfällighet",
    "7": "Ekonomisk förening eller bostadsrättsförening",
    "8": "Ideell förening eller stiftelse",
    "9": "Handelsbolag eller kommanditbolag",
}


def _luhn_check(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def ten_digits(text: Column) -> Column:
    """The ten digits of an organisation number, without the century 16; null if there are not so many."""
    d = digits(text)
    return F.when(F.length(d) == 10, d).when((F.length(d) == 12) & d.startswith("16"), F.substring(d, 3, 10))


def org_number(text: Column) -> Column:
    d = ten_digits(text)
    return F.concat(F.substring(d, 1, 6), F.lit("-"), F.substring(d, 7, 4))


def vat_number(text: Column) -> Column:
    """A VAT number with its country; ten bare digits are Swedish."""
    t = F.upper(F.regexp_replace(text, r"[\s ]", ""))
    d = F.regexp_replace(t, "^[A-Z]{2}", "")
    country = F.when(t.rlike("^[A-Z]{2}"), F.substring(t, 1, 2)).otherwise("SE")
    return F.when(t.rlike(r"^(?:[A-Z]{2})?\d{10,14}$"), F.when((country == "SE") & (F.length(d) == 10), F.concat(F.lit("SE"), d, F.lit("01"))).otherwise(F.concat(country, d)))


def luhn(number: Column) -> Column:
    return F.coalesce(number.rlike(r"^\d+$") & _luhn_check(number), F.lit(False))


def luhn_digit(first: Column) -> Column:
    """The digit that makes nine digits valid."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn_check(F.concat(first, c.cast("string"))))
    return F.when(first.rlike(r"^\d{9}$"), F.try_element_at(fits, F.lit(1)))


def check_org_number(text: Column) -> Column:
    """Struct (valid, digits, formatted, legal_form, reason); the first rule that fails is the reason."""
    d = ten_digits(text)
    reason = (
        F.when(d.isNull(), "length")
        .when(~F.substring(d, 1, 1).isin(*LEGAL_FORMS), "group-digit")
        .when(F.substring(d, 3, 2).try_cast("int") < 20, "not-an-org-number")
        .when(~_luhn_check(d), "checksum")
    )
    forms = F.create_map(*[F.lit(x) for kv in LEGAL_FORMS.items() for x in kv])
    ok = reason.isNull()
    return F.struct(ok.alias("valid"), d.alias("digits"), F.when(ok, org_number(text)).alias("formatted"), F.when(ok, F.try_element_at(forms, F.substring(d, 1, 1))).alias("legal_form"), reason.alias("reason"))


def ean(text: Column) -> Column:
    d = digits(text)
    return F.when(F.length(d).between(8, 14), d)


def last4(text: Column) -> Column:
    d = digits(text)
    return F.when(F.length(d) >= 4, F.right(d, F.lit(4)))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def org_score(labelled: Column, repaired: Column, group: Column) -> Column:
    """Trust in a found organisation number, from 0 to 1."""
    s = F.lit(0.7) + F.when(labelled, 0.25).otherwise(0.0) + F.when(group == "5", 0.05).otherwise(0.0)
    s = s - F.when(group.isin("1", "3", "6"), 0.15).otherwise(0.0) - F.when(repaired, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
