"""Changing records: new versions with their sync columns, never in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import search_name
from tallyloom.operators.categories import guess
from tallyloom.operators.replicate import overlay
from tallyloom.sources.versions import Versions

#: Categories that every replica seeds alike, as (slug, name, scope).
SEEDS = (
    ("livsmedel", "Livsmedel", "both"),
    ("frukt-gront", "Frukt & grönt", "item"),
    ("mejeri", "Mejeri & ägg", "item"),
    ("brod", "Bröd & bageri", "item"),
    ("kott-fisk", "Kött, chark & fisk", "item"),
    ("skafferi", "Skafferi", "item"),
    ("fryst", "Fryst", "item"),
    ("dryck", "Dryck", "item"),
    ("godis-snacks", "Godis & snacks", "item"),
    ("hushall", "Hushåll & städ", "item"),
    ("hygien", "Hygien & apotek", "item"),
    ("pant", "Pant", "item"),
    ("restaurang", "Restaurang & café", "receipt"),
    ("transport", "Transport & drivmedel", "receipt"),
    ("hem", "Hem & inredning", "receipt"),
    ("elektronik", "Elektronik", "receipt"),
    ("klader", "Kläder & skor", "receipt"),
    ("fritid", "Fritid & nöje", "receipt"),
    ("ovrigt", "Övrigt", "both"),
)


def seed_categories(spark: SparkSession) -> DataFrame:
    """The seeded categories; ids follow from slugs, so replicas that seed apart agree."""
    rows = [(f"seed-category-{slug}", name, scope, i) for i, (slug, name, scope) in enumerate(SEEDS)]
    return spark.createDataFrame(rows, "id string, name string, scope string, sort_order int")


def touched(df: DataFrame, now: int) -> DataFrame:
    return df.withColumns({"updated_at": F.lit(now).cast("bigint"), "dirty": F.lit(1)})


def tombstoned(df: DataFrame, now: int) -> DataFrame:
    return touched(df.withColumn("deleted_at", F.lit(now).cast("bigint")), now)


def renamed(items: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """items with the names of names (id, new_name); the search name follows, and only changed rows are touched."""
    joined = items.join(names.select("id", "new_name"), "id", "left")
    changed = F.col("new_name").isNotNull() & (F.col("new_name") != F.coalesce("name", F.lit("")))
    out = joined.withColumn("_changed", F.coalesce(changed, F.lit(False))).withColumn("name", F.when(F.col("_changed"), F.col("new_name")).otherwise(F.col("name")))
    return out.withColumns(
        {
            "search_name": F.when(F.col("_changed"), search_name(F.col("name"))).otherwise(F.col("search_name")),
            "updated_at": F.when(F.col("_changed"), F.lit(now)).otherwise(F.col("updated_at")),
            "dirty": F.when(F.col("_changed"), 1).otherwise(F.col("dirty")),
        }
    ).drop("_changed", "new_name")


def added(items: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """items with the lines of new (receipt_id, id, name, ...), each behind the last line of its receipt, tombstoned
    lines included. A missing name is `Ny rad`; columns that new lacks are null, quantity 1, unit st, total_price 0."""
    last = items.groupBy("receipt_id").agg(F.max("line_no").alias("_last"))
    place = F.row_number().over(Window.partitionBy("receipt_id").orderBy("id"))
    name = F.coalesce(F.col("name"), F.lit("Ny rad")) if "name" in new.columns else F.lit("Ny rad")
    out = new.withColumn("_k", place).join(last, "receipt_id", "left").withColumn("line_no", (F.coalesce("_last", F.lit(-1)) + F.col("_k")).cast("int")).withColumn("name", name)
    for c, v in (("quantity", 1.0), ("unit", "st"), ("total_price", 0)):
        if c in items.columns and c not in new.columns:
            out = out.withColumn(c, F.lit(v).cast(items.schema[c].dataType))
    out = touched(out.withColumn("search_name", search_name(F.col("name"))).withColumn("deleted_at", F.lit(0).cast("bigint")), now).drop("_k", "_last")
    return items.unionByName(out, allowMissingColumns=True)


def _tombstone(rows: DataFrame, hit: Column, deleted_at: int, now: int) -> DataFrame:
    """rows with deleted_at set where hit holds, and these touched."""
    when = lambda value, c: F.when(hit, F.lit(value).cast(rows.schema[c].dataType)).otherwise(F.col(c))
    return rows.withColumns({"deleted_at": when(deleted_at, "deleted_at"), "updated_at": when(now, "updated_at"), "dirty": when(1, "dirty")})


def deleted(rows: DataFrame, ids: DataFrame, now: int, key: str = "id") -> DataFrame:
    """rows with tombstones on those whose key is among ids (id)."""
    gone = ids.select(F.col("id").alias(key), F.lit(True).alias("_gone")).distinct()
    marked = rows.join(gone, key, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    return _tombstone(marked, F.col("_gone"), now, now).select(*rows.columns)


def delete_receipts(receipts: DataFrame, items: DataFrame, links: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receipts of ids with all their lines and tag links tombstoned at one time, by which a restore knows them."""
    return deleted(receipts, ids, now), deleted(items, ids, now, "receipt_id"), deleted(links, ids, now, "receipt_id")


def restore_receipts(receipts: DataFrame, items: DataFrame, links: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undoes delete_receipts: of lines and links only those come back that went with their receipt."""
    back = receipts.join(ids.select("id").distinct(), "id", "left_semi").where("deleted_at <> 0").select(F.col("id").alias("_id"), F.col("deleted_at").alias("_at"))

    def revived(rows: DataFrame, key: str) -> DataFrame:
        joined = rows.join(back, F.col(key) == F.col("_id"), "left")
        marked = joined.withColumn("_hit", F.coalesce(F.col("_at") == F.col("deleted_at"), F.lit(False)))
        return _tombstone(marked, F.col("_hit"), 0, now).select(*rows.columns)

    return revived(receipts, "id"), revived(items, "receipt_id"), revived(links, "receipt_id")


def item_counts(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """receipts with item_count set to their live lines, after lines came or went."""
    n = items.where("deleted_at = 0").groupBy(F.col("receipt_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return receipts.drop("item_count").join(n, "id", "left").withColumn("item_count", F.coalesce("_n", F.lit(0))).drop("_n")


def dirty(tables: dict[str, DataFrame], most: int) -> DataFrame:
    """(kind, id, updated_at, record) of changed rows, at most so many of each kind, the longest changed first; record
    is the row as JSON."""
    out = None
    for kind, rows in tables.items():
        some = rows.where("dirty = 1").orderBy("updated_at", "id").limit(most)
        some = some.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "updated_at", F.to_json(F.struct(*sorted(rows.columns))).alias("record"))
        out = some if out is None else out.unionByName(some)
    return out


def kv_get(kv: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, value) for each wanted (key, fallback): the stored value, or the fallback where there is none."""
    return wanted.join(kv.select("key", F.col("value").alias("_value")), "key", "left").select("key", F.coalesce("_value", "fallback").alias("value"))


def kv_set(kv: DataFrame, new: DataFrame) -> DataFrame:
    """kv with the values of new (key, value) put in or in place."""
    return kv.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


#: Keys that a wipe removes, whole or by their beginning; settings and the device's identity stay.
WIPED_KEYS, WIPED_PREFIXES = ("categories:seeded",), ("sync:", "companies:")


def wiped(tables: dict[str, DataFrame], kv: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables empty, and kv without what belongs to the data."""
    gone = F.col("key").isin(*WIPED_KEYS)
    for p in WIPED_PREFIXES:
        gone = gone | F.col("key").startswith(p)
    return {name: rows.limit(0) for name, rows in tables.items()}, kv.where(~gone)


def create_or_revive(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, id, action) for each wanted name: a live tag of that name in any case is kept, a deleted one revived,
    and otherwise one is created with an id from its name."""
    have = tags.groupBy(F.lower("name").alias("_k")).agg(F.min(F.struct((F.col("deleted_at") != 0).alias("dead"), F.col("id").alias("id"))).alias("t"))
    joined = wanted.select("name").distinct().join(have, F.lower("name") == F.col("_k"), "left")
    action = F.when(F.col("t").isNull(), "create").when(F.col("t.dead"), "revive").otherwise("keep")
    return joined.select("name", F.coalesce("t.id", F.sha2(F.lower("name"), 256)).alias("id"), action.alias("action"))


def apply_extraction(
    receipts: DataFrame, items: DataFrame, readings: DataFrame, fields: Sequence[str], now: int, replaced: Sequence[str] = (), merchant: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """New versions of receipts and items after readings (id, fields, items).

    Live lines of a receipt that was read get tombstones, which count as changed; new ones are numbered from 0, with an
    id from the receipt, the time and their place, their search name, and the seeded category that a word of their name
    points to. Of the fields one that was read takes the place of what was there, and one that was not leaves it;
    replaced are fields that are taken even if they were not read. merchant names the fields of a struct merchant that
    are overlaid one by one. The receipt is parsed and counts its new lines. Receipts without a reading stay as they
    are, and readings of receipts that are not there add nothing. A null list of items is an empty one.
    """
    r = readings.join(receipts.select("id"), "id", "left_semi")
    merchant_of = [*(["merchant"] if merchant else [])]
    taken = [*fields, *replaced, *merchant_of]
    lines = F.coalesce("items", F.array().cast(readings.schema["items"].dataType))
    heads = r.select("id", F.lit(True).alias("_read"), F.size(lines).alias("_lines"), *[F.col(f).alias(f"_{f}") for f in taken])
    out = receipts.join(heads, "id", "left")
    read = F.coalesce(F.col("_read"), F.lit(False))
    new = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields} | {f: F.when(read, F.col(f"_{f}")).otherwise(F.col(f)) for f in replaced}
    if merchant:
        new["merchant"] = F.when(read, overlay(F.col("_merchant"), F.col("merchant"), merchant)).otherwise(F.col("merchant"))
    new |= {"status": F.when(read, "parsed").otherwise(F.col("status")), "updated_at": F.when(read, F.lit(now)).otherwise(F.col("updated_at"))}
    if "dirty" in receipts.columns:
        new["dirty"] = F.when(read, 1).otherwise(F.col("dirty"))
    if "item_count" in receipts.columns:
        new["item_count"] = F.when(read, F.col("_lines")).otherwise(F.col("item_count"))
    headers = out.withColumns(new).select(*receipts.columns)
    of = r.select(F.col("id").alias("receipt_id"), F.lit(True).alias("_hit"))
    marked = items.join(of, "receipt_id", "left")
    dead = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("deleted_at") == 0)
    changed = {c: F.when(dead, F.lit(v).cast(items.schema[c].dataType)).otherwise(F.col(c)) for c, v in (("deleted_at", now), ("updated_at", now), ("dirty", 1)) if c in items.columns}
    old = marked.withColumns(changed).select(*items.columns)
    each = r.select(F.col("id").alias("receipt_id"), F.posexplode(lines).alias("line_no", "_i"))
    given = [f for f in readings.schema["items"].dataType.elementType.names if f in items.columns]
    named = search_name(F.col("_i.name"))
    slug = guess(named)
    made = {
        "line_no": F.col("line_no"), "search_name": named, "category_id": F.when(slug.isNotNull(), F.concat(F.lit("seed-category-"), slug)), "deleted_at": F.lit(0), "updated_at": F.lit(now),
        "dirty": F.lit(1), "id": F.sha2(F.concat_ws("/", "receipt_id", F.lit(now), "line_no"), 256), "rev": F.lit(0),
    } | {f: F.col(f"_i.{f}") for f in given}
    fresh = each.select("receipt_id", *[made[c].cast(items.schema[c].dataType).alias(c) for c in made if c in items.columns])
    return headers, old.unionByName(fresh, allowMissingColumns=True).select(*items.columns)


def commit_extraction(versions: Versions, version: int, readings: DataFrame, fields: Sequence[str], now: int, **more: Sequence[str]) -> None:
    """Applies readings to the tables receipts and items of versions and puts both in place at once: a reader, or a run
    after a crash at any point, sees both as they were or both as they are. Other tables stay."""
    receipts, items = versions.read("receipts"), versions.read("items")
    heads, lines = apply_extraction(receipts, items, readings, fields, now, **more)
    versions.commit(version, {"receipts": heads, "items": lines})


def stable_json(df: DataFrame, columns: Sequence[str], name: str = "json") -> DataFrame:
    """df with the columns as JSON in the order of their names, so equal records have equal text."""
    return df.withColumn(name, F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def base_url(url: Column) -> Column:
    """A server's address without blanks and slashes at its end."""
    return F.regexp_replace(F.trim(url), "/+$", "")


def is_loopback(url: Column) -> Column:
    return F.coalesce(F.call_function("try_parse_url", url, F.lit("HOST")).isin("localhost", "127.0.0.1", "[::1]"), F.lit(False))


def flatten_registry(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Registry answers as company columns, with the answer kept; rows without a valid number are left out."""
    from tallyloom.functions.codes import check_org_number, org_number

    d = F.from_json(json_col, "data struct<organization_number string, name string, status string, address string, sni_codes array<struct<description string>>>")["data"]
    rows = raw.withColumn("_d", d).where(check_org_number(F.col("_d.organization_number"))["valid"])
    return rows.select(org_number(F.col("_d.organization_number")).alias("id"), F.col("_d.name").alias("name"), (F.lower("_d.status") == "active").alias("active"), F.col("_d.address").alias("address"), F.try_element_at(F.col("_d.sni_codes"), F.lit(1))["description"].alias("industry"), F.col(json_col).alias("raw"))
