"""Selecting and ordering receipts and purchases."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.dates import day_key


@dataclass(frozen=True)
class ReceiptFilter:
    """What a receipt must meet; an empty part asks for nothing."""

    query: str = ""
    date_from: str | None = None
    date_to: str | None = None
    categories: Sequence[str] = ()
    tags: Sequence[str] = ()
    statuses: Sequence[str] = ()
    total_min: float | None = None
    total_max: float | None = None
    review: bool = False
    sort: str = "date"
    direction: str = "desc"

    def to_params(self) -> dict[str, str]:
        return _params(self)

    @classmethod
    def from_params(cls, params: dict[str, str]) -> ReceiptFilter:
        return cls(**_parsed(cls, params))


@dataclass(frozen=True)
class PurchaseFilter:
    """What a purchased line must meet; discounts and deposits are asked for expressly."""

    query: str = ""
    date_from: str | None = None
    date_to: str | None = None
    categories: Sequence[str] = ()
    merchants: Sequence[str] = ()
    price_min: float | None = None
    price_max: float | None = None
    discounts: bool = False
    deposits: bool = False
    sort: str = "date"
    direction: str = "desc"

    def to_params(self) -> dict[str, str]:
        return _params(self)

    @classmethod
    def from_params(cls, params: dict[str, str]) -> PurchaseFilter:
        return cls(**_parsed(cls, params))


#: Names of the parameters in a link.
PARAMS = {
    "query": "q", "date_from": "from", "date_to": "to", "categories": "cat", "tags": "tag", "statuses": "status", "merchants": "shop",
    "total_min": "min", "total_max": "max", "price_min": "min", "price_max": "max", "review": "review", "discounts": "disc", "deposits": "pant",
    "sort": "sort", "direction": "dir",
}


def number(value: str | None) -> float | None:
    """A number of a link; a blank one is 0 and what is not a finite number is none."""
    if value is None:
        return None
    try:
        x = float(value) if value.strip() else 0.0
    except ValueError:
        return None
    return x if abs(x) < float("inf") else None


def _params(spec: ReceiptFilter | PurchaseFilter) -> dict[str, str]:
    out = {}
    for f in fields(spec):
        v = getattr(spec, f.name)
        if v is None or v == f.default:
            continue
        out[PARAMS[f.name]] = "1" if v is True else ",".join(v) if isinstance(v, (list, tuple)) else f"{v:g}" if isinstance(v, float) else v
    return out


def _parsed(cls: type, params: dict[str, str]) -> dict:
    out = {}
    for f in fields(cls):
        raw = params.get(PARAMS[f.name])
        if raw is None:
            continue
        if f.name in ("categories", "tags", "statuses", "merchants"):
            out[f.name] = tuple(x for x in raw.split(",") if x)
        elif f.name.endswith(("_min", "_max")):
            out[f.name] = number(raw)
        elif f.name == "direction":
            out[f.name] = "asc" if raw == "asc" else "desc"
        else:
            out[f.name] = raw == "1" if isinstance(f.default, bool) else raw
    return out


def preset(name: str, as_of: str) -> ReceiptFilter:
    """The quick filters: what needs review, this month, and what nothing has been read from."""
    return {"review": ReceiptFilter(review=True), "month": ReceiptFilter(date_from=f"{as_of[:7]}-01"), "unread": ReceiptFilter(statuses=("draft", "failed"))}[name]


def in_dates(date: Column, first: str | None, last: str | None) -> Column:
    """Inclusive on days; without bounds all pass, with one a null date does not."""
    out = F.lit(True)
    if first:
        out = out & (day_key(date) >= first)
    if last:
        out = out & (day_key(date) <= last)
    return F.coalesce(out, F.lit(False))


def dated(receipts: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """receipts within inclusive days. A date column purchased_on is filtered as it is, so that the scan skips what
    lies outside; text dates are compared by their day. Bounds that are no whole day are compared as text."""
    if "purchased_on" in receipts.columns and all(b is None or re.fullmatch(r"\d{4}-\d{2}-\d{2}", b) for b in (first, last)):
        if first:
            receipts = receipts.where(F.col("purchased_on") >= F.lit(first).cast("date"))
        return receipts.where(F.col("purchased_on") < F.date_add(F.lit(last).cast("date"), 1)) if last else receipts
    return receipts.where(in_dates(F.col("purchased_at"), first, last))


def needs_review(status: Column, warnings: Column) -> Column:
    return F.when(status == "failed", True).when(status == "confirmed", False).otherwise(F.size(warnings) > 0)


def with_all_tags(receipts: DataFrame, links: DataFrame, wanted: Sequence[str], key: str = "receipt_id") -> DataFrame:
    """Receipts that carry every wanted tag: links of wanted tags are counted by receipt ahead of a semi-join."""
    if not wanted:
        return receipts
    full = links.where(F.col("tag_id").isin(*wanted)).groupBy(key).agg(F.count_distinct("tag_id").alias("n")).where(F.col("n") == len(set(wanted)))
    return receipts.join(full, receipts["id"] == full[key], "left_semi")


def matching(receipts: DataFrame, items: DataFrame, query: str, haystack: Sequence[str] = ("merchant", "city")) -> DataFrame:
    """Receipts whose own text holds all terms, or with an item whose name holds any of them.

    The items' side is reduced to ids before it is joined, so a receipt is never repeated.
    """
    wanted = text.terms(query)
    if not wanted:
        return receipts
    ids = items.where(text.any_in(F.col("search_name"), wanted)).select(F.col("receipt_id").alias("_hit")).distinct()
    own = text.all_in(F.lower(F.concat_ws(" ", *[F.col(c) for c in haystack])), wanted)
    return receipts.join(ids, receipts["id"] == ids["_hit"], "left").where(own | F.col("_hit").isNotNull()).drop("_hit")


def receipts_where(receipts: DataFrame, spec: ReceiptFilter, links: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Live receipts that meet spec; links and items are only read if it asks for tags or text."""
    df = dated(receipts.where("deleted_at = 0"), spec.date_from, spec.date_to)
    if spec.statuses:
        df = df.where(F.col("status").isin(*spec.statuses))
    if spec.categories:
        df = df.where(F.col("category_id").isin(*spec.categories))
    total = F.coalesce(F.col("total"), F.lit(0))
    if spec.total_min is not None:
        df = df.where(total >= spec.total_min)
    if spec.total_max is not None:
        df = df.where(total <= spec.total_max)
    if spec.review:
        df = df.where(needs_review(F.col("status"), F.col("warnings")))
    if spec.tags:
        df = with_all_tags(df, links, spec.tags)
    return matching(df, items, spec.query) if spec.query else df


def purchases(items: DataFrame, receipts: DataFrame, spec: PurchaseFilter = PurchaseFilter()) -> DataFrame:  # noqa: B008
    """Lines of live receipts with what they take from the receipt; lines without a receipt drop out."""
    if not spec.discounts:
        items = items.where(~F.col("is_discount"))
    if not spec.deposits:
        items = items.where(~F.col("is_deposit"))
    if spec.categories:
        items = items.where(F.col("category_id").isin(*spec.categories))
    if spec.price_min is not None:
        items = items.where(F.col("total_price") >= spec.price_min)
    if spec.price_max is not None:
        items = items.where(F.col("total_price") <= spec.price_max)
    of = dated(receipts.where("deleted_at = 0"), spec.date_from, spec.date_to)
    if spec.merchants:
        of = of.where(F.lower(F.coalesce(F.col("merchant"), F.lit(""))).isin(*[m.lower() for m in spec.merchants]))
    of = of.select(F.col("id").alias("receipt_id"), "merchant", "purchased_at", "city", F.col("category_id").alias("receipt_category_id"))
    rows = items.join(of, "receipt_id")
    wanted = text.terms(spec.query)
    if wanted:
        rows = rows.where(text.all_in(F.concat_ws(" ", "search_name", F.lower(F.coalesce(F.col("merchant"), F.lit("")))), wanted))
    return rows


def _both_ways(c: Column, descending: bool) -> Column:
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def receipt_order(by: str, descending: bool) -> list[Column]:
    """Sort keys; undated receipts come last both ways, the latest changed first. The id settles ties."""
    added = F.col("updated_at")
    if by == "date":
        return [F.col("purchased_at").isNull().asc(), _both_ways(F.col("purchased_at"), descending), F.when(F.col("purchased_at").isNull(), added).desc_nulls_last(), F.col("id").asc()]
    keys = {"total": F.coalesce(F.col("total"), F.lit(0)), "merchant": F.collate(F.coalesce(F.col("merchant"), F.lit("")), "sv"), "added": added, "items": F.coalesce(F.col("item_count"), F.lit(0)) if by == "items" else None}
    return [_both_ways(keys[by], descending), F.col("id").asc()]


def purchase_order(by: str, descending: bool) -> list[Column]:
    if by == "date":
        return [F.col("purchased_at").isNull().asc(), _both_ways(F.col("purchased_at"), descending), F.when(F.col("purchased_at").isNull(), F.col("search_name")).asc_nulls_last(), F.col("line_no").asc(), F.col("receipt_id").asc(), F.col("part_id").asc(), F.col("total_price").asc()]
    keys = {"name": F.collate(F.col("search_name"), "sv"), "price": F.col("total_price"), "quantity": F.col("quantity"), "merchant": F.collate(F.coalesce(F.col("merchant"), F.lit("")), "sv"), "unit_price": F.coalesce(F.col("unit_price"), F.lit(0)) if by == "unit_price" else None}
    return [_both_ways(keys[by], descending), F.col("receipt_id").asc(), F.col("line_no").asc(), F.col("part_id").asc(), F.col("total_price").asc()]


def page(df: DataFrame, order: list[Column], pages: int, rows: int = 150) -> DataFrame:
    """The first pages of an ordered list."""
    return df.orderBy(*order).limit(pages * rows)
