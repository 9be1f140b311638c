"""Last-write-wins replication over a log of revisions, and field-by-field merging of receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.order import placed

#: Kinds of records in the order in which revisions are given out.
KINDS = ("companies", "receipts", "items", "categories", "tags", "receiptTags", "secrets")
ID_MOST, PAYLOAD_MOST, SECRET_MOST = 128, 512 * 1024, 16_384


def version(updated: str = "updated_at", deleted: str = "deleted_at", payload: str = "payload") -> Column:
    """What decides between versions: the later, then the deleted one, then the larger content."""
    return F.struct(F.col(updated), (F.col(deleted) != 0).alias("deleted"), F.col(payload))


def resolve(changes: DataFrame, key: Sequence[str] = ("kind", "id"), tie: str = "rev") -> DataFrame:
    """The winning version of each record, by an aggregate that combines ahead of the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    if any(t in f.dataType.simpleString() for f in changes.schema for t in ("map<", "variant", "interval")):
        order = F.struct(version().alias("v"), (-F.col(tie)).alias("t"))
        return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("w")).select(*key, "w.*")
    # with the content among what is compared and not beside it, each record is shuffled once
    order = [F.col("updated_at"), (F.col("deleted_at") != 0).alias("_deleted"), F.col("payload"), (-F.col(tie)).alias("_tie")]
    others = [c for c in rest if c not in ("updated_at", "payload")]
    return changes.groupBy(*key).agg(F.max(F.struct(*order, *others)).alias("w")).select(*key, *[F.col(f"w.{c}") for c in rest])


def rejected(kind: Column, record_id: Column, updated: Column, deleted: Column, payload: Column, kinds: Sequence[str] = KINDS, secrets: Sequence[str] = (), value: Column | None = None) -> Column:
    """Why a pushed record is not taken, or null; the first rule that fails.

    secrets are the ids that records of kind secrets may have; value is their text.
    """
    size = F.octet_length(payload)
    is_secret = F.coalesce(kind == "secrets", F.lit(False))
    value = F.lit(None).cast("string") if value is None else value
    return (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "kind")
        .when(record_id.isNull() | (F.length(record_id) == 0) | (F.length(record_id) > ID_MOST), "id")
        .when(updated.isNull() | F.isnan(updated.cast("double")) | deleted.isNull() | F.isnan(deleted.cast("double")), "meta")
        .when(is_secret & ~F.coalesce(record_id.isin(*secrets), F.lit(False)), "secret")
        .when(is_secret & (value.isNull() | (F.length(value) > SECRET_MOST)), "value")
        .when(size > PAYLOAD_MOST, "size")
    )


def outcomes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming with outcome applied or stale: equal versions keep what is stored."""
    s = stored.select("kind", "id", F.struct(F.col("updated_at").alias("u"), (F.col("deleted_at") != 0).alias("d"), F.col("payload").alias("p")).alias("_stored"))
    mine = F.struct(F.col("updated_at").alias("u"), (F.col("deleted_at") != 0).alias("d"), F.col("payload").alias("p"))
    return incoming.join(s, ["kind", "id"], "left").withColumn("outcome", F.when(F.col("_stored").isNull() | (mine > F.col("_stored")), "applied").otherwise("stale")).drop("_stored")


def revisions(applied: DataFrame, base: int, order: str, kinds: Sequence[str] = KINDS, ranges: int | None = None) -> DataFrame:
    """applied with gapless revisions after base: kinds in the order of kinds, then by the column order.

    Ranges of the order are drawn from the data, so neither a large kind nor an order that bunches comes to one task.
    Rows that tie in kind and order must be alike. Kinds that kinds does not name come last.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0))
    keyed = applied.withColumn("_kind", F.when(place == 0, len(kinds) + 1).otherwise(place))
    return placed(keyed, [F.col("_kind").asc(), F.col(order).asc()], "new_rev", ranges, base).drop("_kind")


def written_by_server(changes: DataFrame, records: DataFrame, last_rev: int, device: str = "server") -> DataFrame:
    """What the log gains when the server itself writes records (kind, id, seq, updated_at, deleted_at, payload): new
    revisions for all, without a look for conflicts, marked as the server's own. The log's columns are those of changes."""
    out = revisions(records, last_rev, "seq").withColumn("rev", F.col("new_rev")).withColumn("device", F.lit(device))
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in changes.columns])


def pull(changes: DataFrame, since: int, rows: int) -> DataFrame:
    """The next page of the log; a limit over an order takes so many rows from each task only."""
    return changes.where(F.col("rev") > since).orderBy("rev").limit(rows)


def has_more(changes: DataFrame, since: int, rows: int) -> bool:
    return changes.where(F.col("rev") > since).limit(rows + 1).count() > rows


def page_with_cursor(changes: DataFrame, since: int, rows: int) -> DataFrame:
    """The next page with the cursor to go on from, and whether there is more behind it, on each of its rows."""
    cut = pull(changes, since, rows + 1)
    w = Window.orderBy("rev")  # over one page
    numbered = cut.withColumn("_k", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > rows)
    page = numbered.where(F.col("_k") <= rows).drop("_k")
    return page.withColumn("cursor", F.max("rev").over(Window.partitionBy()))


def pending(changes: DataFrame, since: int) -> DataFrame:
    """Rows after since by kind, and their total as kind null."""
    return changes.where(F.col("rev") > since).rollup("kind").agg(F.count(F.lit(1)).alias("n"))


def sync_status(cursors: DataFrame, epoch: str, counter: int) -> DataFrame:
    """Where each reader goes on: from 0 if the epoch differs or its cursor is past the counter."""
    diverged = (F.col("epoch") != epoch) | (F.col("cursor") > counter)
    return cursors.withColumn("diverged", diverged).withColumn("next", F.when(diverged, 0).otherwise(F.col("cursor"))).withColumn("has_changes", F.col("next") < counter)


def acknowledge(snapshot: DataFrame, now: DataFrame, results: DataFrame) -> DataFrame:
    """now with dirty cleared where the push was taken and nothing changed since the snapshot."""
    s = snapshot.select("kind", "id", F.col("updated_at").alias("_then"))
    r = results.select("kind", "id", F.col("outcome").alias("_outcome"), F.col("new_rev").alias("_rev"))
    clean = F.coalesce((F.col("_outcome") != "rejected") & (F.col("_then") == F.col("updated_at")), F.lit(False))
    joined = now.join(s, ["kind", "id"], "left").join(r, ["kind", "id"], "left")
    return joined.withColumn("dirty", F.when(clean, 0).otherwise(F.col("dirty"))).withColumn("rev", F.coalesce("_rev", "rev")).drop("_then", "_outcome", "_rev")


def apply_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(kind, id, chosen): what a pulled record does to the local one.

    A record without a local edit is taken. A receipt that the server's own reader wrote over a local edit is merged
    field by field (merge_incoming); among other edited records the version decides, and where the local one stays it
    takes on the server's revision ("keep"). Records without a counterpart are "local" or "remote". remote may have
    machine, whether the reader wrote it.
    """
    if "machine" not in remote.columns:
        remote = remote.withColumn("machine", F.lit(False))
    lv = F.struct(F.col("l.updated_at").alias("u"), (F.col("l.deleted_at") != 0).alias("d"), F.col("l.payload").alias("p"))
    rv = F.struct(F.col("r.updated_at").alias("u"), (F.col("r.deleted_at") != 0).alias("d"), F.col("r.payload").alias("p"))
    joined = local.alias("l").join(remote.alias("r"), (F.col("l.kind") == F.col("r.kind")) & (F.col("l.id") == F.col("r.id")), "full")
    merges = (F.col("l.kind") == "receipts") & F.col("r.machine") & (F.col("r.deleted_at") == 0) & (F.col("l.deleted_at") == 0)
    chosen = (
        F.when(F.col("r.id").isNull(), "local").when(F.col("l.id").isNull() | (F.col("l.dirty") == 0), "remote")
        .when(merges, "merge").when(rv > lv, "remote").otherwise("keep")
    )
    return joined.select(F.coalesce("l.kind", "r.kind").alias("kind"), F.coalesce("l.id", "r.id").alias("id"), chosen.alias("chosen"))


def enrich(receipts: DataFrame, found: DataFrame, fields: Sequence[str], fixed: Sequence[str] = (), blocks: Sequence[str] = (), replace_own: bool = False) -> DataFrame:
    """Receipts with what a reading found, which has the same columns by id.

    Deleted and confirmed receipts are left. Of fields blanks are filled; with replace_own values that a machine wrote
    (machine is true) are replaced too, but never those of fixed, which once set stay. blocks are arrays, such as VAT
    lines, and are taken whole or not at all. Where both sides have currency it is taken if it differs and the receipt
    has no items; where both have items they are taken whole if the receipt has none. filled and kept name what came
    in and what stayed, skipped says why nothing was done. A draft or failed receipt that gains anything is parsed.
    """
    special = [c for c in ("currency", "items") if c in receipts.columns and c in found.columns]
    every = [*fields, *blocks, *special]
    f = found.select("id", *[F.col(c).alias(f"_{c}") for c in every], F.lit(True).alias("_found"))
    joined = receipts.join(f, "id", "left")
    own = F.coalesce(F.col("machine"), F.lit(False)) if replace_own and "machine" in receipts.columns else F.lit(False)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    no_items = ~some(F.col("items")) if "items" in receipts.columns else F.lit(True)
    fill, keep = {}, {}
    for c in fields:
        new, here = F.col(f"_{c}").isNotNull(), F.col(c).isNotNull()
        fill[c] = new & (~here | (own & (F.lit(c not in fixed) & ~F.col(c).eqNullSafe(F.col(f"_{c}")))))
        keep[c] = new & here & (~own | F.lit(c in fixed))
    for c in blocks:
        fill[c] = some(F.col(f"_{c}")) & (~some(F.col(c)) | own)
        keep[c] = some(F.col(f"_{c}")) & some(F.col(c)) & ~own
    if "currency" in special:
        fill["currency"] = F.col("_currency").isNotNull() & ~F.col("currency").eqNullSafe(F.col("_currency")) & no_items
        keep["currency"] = F.lit(False)
    if "items" in special:
        fill["items"], keep["items"] = some(F.col("_items")) & no_items, some(F.col("_items")) & ~no_items
    names = lambda of: F.filter(F.array(*[F.when(test, F.lit(c)) for c, test in of.items()]), lambda x: x.isNotNull())
    skipped = F.when(F.col("_found").isNull(), "not-found").when(F.col("deleted_at") != 0, "deleted").when(F.col("status") == "confirmed", "confirmed").when(F.size(names(fill)) == 0, "nothing-new")
    out = joined.withColumn("skipped", skipped)
    go = F.col("skipped").isNull()
    looked = go | (F.col("skipped") == "nothing-new")
    none = F.array().cast("array<string>")
    out = out.withColumn("filled", F.when(go, names(fill)).otherwise(none)).withColumn("kept", F.when(looked, names(keep)).otherwise(none))
    out = out.withColumns({f"_{c}": F.when(go & test, F.col(f"_{c}")).otherwise(F.col(c)) for c, test in fill.items()})
    out = out.withColumns({c: F.col(f"_{c}") for c in every})
    return out.withColumn("status", F.when(go & F.col("status").isin("draft", "failed"), "parsed").otherwise(F.col("status"))).drop("_found", *[f"_{c}" for c in every])


def merge_incoming(local: DataFrame, remote: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A machine-written remote version under local edits: what the user has set stays, and the rest comes in.

    Only pairs of live records whose local side is dirty merge; a confirmed local one only takes the revision.
    """
    r = remote.where("machine and deleted_at = 0").select("id", F.col("rev").alias("_rev"), F.col("updated_at").alias("_updated"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = local.where("dirty = 1 and deleted_at = 0").join(r, "id")
    fixed = F.col("status") == "confirmed"
    out = joined.withColumns({c: F.when(fixed, F.col(c)).otherwise(F.coalesce(F.col(c), F.col(f"_{c}"))) for c in fields})
    return out.withColumn("updated_at", F.when(fixed, F.col("updated_at")).otherwise(F.greatest("updated_at", "_updated") + 1)).withColumn("rev", F.col("_rev")).drop("_rev", "_updated", *[f"_{c}" for c in fields])


def overlay(new: Column, old: Column, fields: Sequence[str]) -> Column:
    """A struct with the new value of each field, or the old one where that is null."""
    return F.struct(*[F.coalesce(new[f], old[f]).alias(f) for f in fields])
