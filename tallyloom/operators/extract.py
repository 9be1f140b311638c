"""Semi-structured readings of receipts to typed columns, over VARIANT."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from tallyloom.functions import codes, text
from tallyloom.functions.base import let
from tallyloom.functions.dates import parse_date
from tallyloom.functions.money import UNITS, gross, parse_amount, parse_quantity, round_half_up, unit_price, vat_rate
from tallyloom.operators.quality import line_class

#: Names that a field goes by, first come first taken.
TOTAL = ("total", "totalAmount", "amountPaid", "attBetala")
DATE = ("purchasedAt", "purchased_at", "date", "datetime", "dateTime")
ITEMS = ("items", "lineItems", "line_items", "products")
VAT = ("vatLines", "vat_lines", "vat", "moms")
MERCHANT = ("merchant", "store", "seller")
SELLER = {
    "name": ("name", "merchant", "store", "storeName"), "org_number": ("orgNumber", "org_number", "orgnr"), "vat_number": ("vatNumber", "vat_number", "momsnr"),
    "address": ("address", "street"), "postal_code": ("postalCode", "postal_code", "zip"), "city": ("city", "town", "ort"), "country": ("country",),
    "phone": ("phone", "tel", "telefon"), "store_id": ("storeId", "store_id", "butiksnummer"),
}
PRINTED_AS = {
    "payment_method": ("paymentMethod", "payment_method", "payment"), "receipt_number": ("receiptNumber", "receipt_number", "kvittonummer"),
    "terminal_id": ("terminalId", "terminal", "kassa"), "cashier": ("cashier", "kassör", "kassor"),
}
#: What a reading must have, each field with the types it may be of. A list says what its elements have.
TEXT, WORDS, NUMBER = ("STRING", "VOID"), ("STRING",), ("NUMBER", "VOID")
CONTRACT: dict = {
    "merchant": {f: TEXT for f in ("name", "orgNumber", "vatNumber", "address", "postalCode", "city", "country", "phone", "storeId")},
    "purchasedAt": TEXT, "currency": TEXT, "total": TEXT, "subtotal": TEXT, "discountTotal": TEXT, "roundingAmount": TEXT, "depositTotal": TEXT,
    "vatLines": [{"rate": WORDS} | {f: TEXT for f in ("net", "vat", "gross")}],
    "paymentMethod": TEXT, "cardLast4": TEXT, "receiptNumber": TEXT, "terminalId": TEXT, "cashier": TEXT,
    "items": [{"name": WORDS, "totalPrice": WORDS} | {f: TEXT for f in ("rawName", "quantity", "unit", "unitPrice", "discount", "vatRate", "ean", "deposit")}],
    "confidence": NUMBER,
}


_DECODER = json.JSONDecoder()


def first_object(reply: str | None) -> str | None:
    """The first balanced JSON object in a text that can be parsed, the outermost of those that begin alike; braces
    inside strings do not count. One pass finds where each open brace closes, so a text of open braces costs no more
    than another."""
    reply = reply or ""
    start = reply.find("{")
    if start < 0:
        return None
    try:
        return reply[start : _DECODER.raw_decode(reply, start)[1]]
    except (ValueError, RecursionError):
        pass  # it is not the first brace, or not one that closes
    open_at: list[int] = []
    closed: dict[int, int] = {}
    quoted = skip = False
    for i, ch in enumerate(reply):
        if skip:
            skip = False
        elif quoted:
            quoted, skip = ch != '"', ch == "\\"
        elif ch == '"' and open_at:
            quoted = True
        elif ch == "{":
            open_at.append(i)
        elif ch == "}" and open_at:
            closed[open_at.pop()] = i
    past = -1
    for start in sorted(closed):
        if start < past:
            continue  # inside one that was looked at
        text = reply[start : closed[start] + 1]
        try:
            if isinstance(json.loads(text), dict):
                return text
        except ValueError:
            pass
        past = closed[start] if not open_at else past
    return None


def json_object(replies: Column) -> Column:
    def run(replies: pd.Series) -> pd.Series:
        return pd.Series([first_object(r) for r in replies], dtype="object")

    return F.pandas_udf(run, "string")(replies)


def parsed(raw: DataFrame, name: str, json_col: str = "json") -> DataFrame:
    """raw with the first object of each text as a variant, null if there is none. Where all from the first opening brace
    to the last closing one is an object, as in most texts, that is the one; only others are searched in Python."""
    reply = F.col(json_col)
    first, last = F.instr(reply, "{"), F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    outer = F.try_parse_json(F.when(F.contains(reply, F.lit("}")) & (first > 0), F.substring(reply, first, F.greatest(last - first + 1, F.lit(0)))))
    df = raw.withColumn("_outer", outer).withColumn("_other", F.when(F.col("_outer").isNull(), reply))
    return df.withColumn(name, F.coalesce("_outer", F.try_parse_json(json_object(F.col("_other"))))).drop("_outer", "_other")


def pick(v: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the named fields that is neither missing, null nor empty."""
    got = [F.try_variant_get(v, f"$.{n}", kind) for n in names]
    return F.coalesce(*([F.nullif(g, F.lit("")) for g in got] if kind == "string" else got))


def pick_text(v: Column, names: tuple[str, ...]) -> Column:
    return text.nothing_to_null(pick(v, names))


def _array(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names], F.array().cast("array<variant>"))


def _item(v: Column) -> Column:
    raw = pick_text(v, ("rawName", "raw_name", "printedName"))
    name = F.trim(F.coalesce(pick_text(v, ("name", "description", "product", "title")), raw, F.lit("")))
    total = parse_amount(pick(v, ("totalPrice", "total_price", "total", "amount", "price")))
    q = parse_quantity(pick(v, ("quantity", "qty", "antal")))
    unit = F.lower(F.regexp_replace(F.coalesce(pick_text(v, ("unit", "enhet")), F.lit("")), r"\.", ""))
    kind = line_class(F.concat(name, F.lit(" "), F.coalesce(raw, F.lit(""))), total)
    return F.struct(
        name.alias("name"), raw.alias("raw_name"), text.search_name(name).alias("search_name"), q["quantity"].alias("quantity"),
        F.when(unit.isin("other", *set(UNITS.values())), unit).otherwise(q["unit"]).alias("unit"),
        unit_price(parse_amount(pick(v, ("unitPrice", "unit_price", "jmfpris", "styckpris"))), total, q["quantity"], kind == "discount").alias("unit_price"),
        total.alias("total_price"), F.abs(parse_amount(pick(v, ("discount", "rabatt")))).alias("discount"),
        vat_rate(parse_amount(pick(v, ("vatRate", "vat_rate", "moms", "momssats")))).alias("vat_rate"), codes.ean(pick_text(v, ("ean", "gtin", "barcode"))).alias("ean"),
        (kind == "deposit").alias("is_deposit"), (kind == "discount").alias("is_discount"),
    )


def _vat_line(v: Column) -> Column:
    net, vat = parse_amount(pick(v, ("net", "netto", "excl"))), parse_amount(pick(v, ("vat", "moms", "tax")))
    return F.struct(vat_rate(parse_amount(pick(v, ("rate", "percent", "momssats", "sats")))).alias("rate"), net.alias("net"), vat.alias("vat"), gross(parse_amount(pick(v, ("gross", "brutto", "incl", "total"))), net, vat).alias("gross"))


def _seller(v: Column) -> Column:
    """The nine fields of a merchant; numbers are brought to one form, or null if they have none."""
    form = {"org_number": codes.org_number, "vat_number": codes.vat_number}
    read = {c: pick_text(v, names) for c, names in SELLER.items()}
    return F.struct(*[(let(x, form[c]) if c in form else x).alias(c) for c, x in read.items()])


def normalize(raw: DataFrame, as_of: str, json_col: str = "json") -> DataFrame:
    """raw with typed columns of each reading; nothing in it makes the query fail, and warnings tell what was odd.

    Lines without a name, or without a price that can be read, are dropped, the latter with a warning. A missing total
    is taken from the VAT lines, or else from the lines.
    """
    df = parsed(raw, "v", json_col)
    v = F.col("v")
    sum_of = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(f(x), F.lit(0.0)))
    df = df.withColumn("_lines", F.filter(F.transform(_array(v, ITEMS), _item), lambda x: x["name"] != "")).withColumn("vat_lines", F.filter(F.transform(_array(v, VAT), _vat_line), lambda x: x["rate"].isNotNull()))
    df = df.withColumn("items", F.filter("_lines", lambda x: x["total_price"].isNotNull()))
    df = df.withColumn("_date", pick_text(v, DATE)).withColumn("purchased_at", parse_date(F.col("_date"), as_of)).withColumn("_total", parse_amount(pick(v, TOTAL)))
    df = df.withColumn("_gross", sum_of(F.col("vat_lines"), lambda x: x["gross"])).withColumn("_sum", sum_of(F.col("items"), lambda x: x["total_price"]))
    deposits = sum_of(F.filter("items", lambda x: x["is_deposit"]), lambda x: x["total_price"])
    currency = pick_text(v, ("currency",))
    seller = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in MERCHANT])
    df = df.withColumn("seller", let(seller, _seller))
    trouble = F.array(
        F.when(F.col("_date").isNotNull() & F.col("purchased_at").isNull(), F.concat(F.lit("unreadable date: "), F.col("_date"))),
        F.when(F.col("_total").isNull(), F.when(F.col("_gross") > 0, "total from VAT lines").when(F.size("items") > 0, "total from lines").otherwise("no total")),
    )
    unread = F.transform(F.filter("_lines", lambda x: x["total_price"].isNull()), lambda x: F.concat(F.lit("no price: "), x["name"]))
    df = df.withColumns(
        {
            "merchant": F.col("seller.name"), "org_number": F.col("seller.org_number"),
            "subtotal": parse_amount(pick(v, ("subtotal", "sum", "netTotal"))), **{c: pick_text(v, names) for c, names in PRINTED_AS.items()},
            "currency": F.when(currency.rlike("^[A-Za-z]{3}$"), F.upper(currency)).otherwise("SEK"), "card_last4": codes.last4(pick_text(v, ("cardLast4", "card_last4", "cardNumber"))),
            "total": F.coalesce("_total", F.when(F.col("_gross") > 0, round_half_up(F.col("_gross"))), F.when(F.size("items") > 0, round_half_up(F.col("_sum")))),
            "discount_total": F.abs(parse_amount(pick(v, ("discountTotal", "discount", "totalDiscount")))), "rounding_amount": parse_amount(pick(v, ("roundingAmount", "rounding", "oresavrundning"))),
            "deposit_total": F.coalesce(parse_amount(pick(v, ("depositTotal", "deposit", "pant"))), F.when(deposits != 0, round_half_up(deposits))),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), pick(v, ("confidence",), "double"))),
            "warnings": F.concat(F.filter(trouble, lambda x: x.isNotNull()), unread),
        }
    )
    return df.drop("v", "_lines", "_date", "_total", "_gross", "_sum")


def contract(spec: dict = CONTRACT) -> StructType:
    """The reading that spec asks for as a schema; amounts are text, as they are printed."""

    def kind(part) -> DataType:
        if isinstance(part, dict):
            return contract(part)
        if isinstance(part, list):
            return ArrayType(contract(part[0]))
        return DoubleType() if "NUMBER" in part else StringType()

    return StructType([StructField(name, kind(part), not (part == WORDS or isinstance(part, (dict, list)))) for name, part in spec.items()])


MAP = "map<string,variant>"


def _kind(v: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, OBJECT, ARRAY or VOID."""
    k = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.coalesce(F.when(k.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "NUMBER").otherwise(k), F.lit("VOID"))


def _note(path: Column, problem: Column) -> Column:
    return F.struct(path.alias("path"), problem.alias("problem"))


def _is(path: Column, v: Column) -> Column:
    return F.array(_note(path, F.concat(F.lit("is "), F.lower(_kind(v)))))


def _odd(fields: Column, spec: dict, path: Column) -> Column:
    """(path, problem) of an object's fields, a map, against spec. Fields without parts of their own are looked at in one
    go over the map; within a function of elements nothing that is named twice is kept from being computed twice."""
    known, keys = F.array(*[F.lit(n) for n in spec]), F.map_keys(fields)
    plain = {n: kinds for n, kinds in spec.items() if isinstance(kinds, tuple)}
    right = [f"{n}:{k}" for n, kinds in plain.items() for k in kinds]
    wrong = F.filter(F.map_entries(fields), lambda e: e["key"].isin(*plain) & ~F.concat(e["key"], F.lit(":"), _kind(e["value"])).isin(*right))
    out = [
        F.transform(F.array_except(keys, known), lambda k: _note(F.concat(path, k), F.lit("unexpected"))),
        F.transform(F.array_except(known, keys), lambda k: _note(F.concat(path, k), F.lit("missing"))),
        F.transform(wrong, lambda e: _note(F.concat(path, e["key"]), F.concat(F.lit("is "), F.lower(_kind(e["value"]))))),
    ]
    none = F.array().cast("array<struct<path:string,problem:string>>")
    for name, part in spec.items():
        if name not in plain:
            at, here = F.concat(path, F.lit(name)), F.element_at(fields, F.lit(name))
            odd = _odd_object(here, part, at) if isinstance(part, dict) else _odd_array(here, part[0], at)
            out.append(F.when(F.array_contains(keys, name), F.coalesce(odd, _is(at, here))).otherwise(none))
    return F.concat(*out)


def _odd_object(v: Column, spec: dict, path: Column) -> Column:
    """What is odd about an object; null if it is none."""
    return let(F.try_variant_get(v, "$", MAP), lambda m: F.when(m.isNotNull(), _odd(m, spec, F.concat(path, F.lit(".")))))


def _odd_array(v: Column, spec: dict, path: Column) -> Column:
    """What is odd about the elements of an array; null if it is none."""

    def look(x: Column, i: Column) -> Column:
        place = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return F.coalesce(_odd_object(x, spec, place), _is(place, x))

    return F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), look))


def departures(raw: DataFrame, json_col: str = "json", spec: dict = CONTRACT) -> DataFrame:
    """raw's other columns with (path, problem) for everything in which a reading departs from spec: missing, unexpected,
    or the type that it is of instead. A text without an object has the path empty and the problem unreadable."""
    rest = [c for c in raw.columns if c != json_col]
    fields = F.try_variant_get("_v", "$", MAP)
    found = let(fields, lambda m: F.when(m.isNull(), F.array(_note(F.lit(""), F.lit("unreadable")))).otherwise(_odd(m, spec, F.lit(""))))
    return parsed(raw, "_v", json_col).select(*rest, F.explode(found).alias("_d")).select(*rest, "_d.path", "_d.problem")


def prompt(problems: Column, previous: Column, extra: str = "") -> Column:
    """A request to read a receipt again: what was wrong as a list, and the reading so far."""
    return F.concat_ws("\n", F.lit("Read the receipt again."), F.lit(extra) if extra else None, F.array_join(F.transform(problems, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("Previous reading:"), previous) if extra else F.concat_ws("\n", F.lit("Read the receipt again."), F.array_join(F.transform(problems, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("Previous reading:"), previous)


def read_with(images: DataFrame, reader, schema: str = "id string, json string, error string") -> DataFrame:
    """Calls reader(content) for each image on the executors; what it raises becomes the row's error."""

    def run(batches):
        for df in batches:
            out = []
            for i, content in zip(df["id"], df["content"], strict=True):
                try:
                    out.append((i, reader(bytes(content)), None))
                except Exception as e:  # noqa: BLE001  one image must not fail the rest
                    out.append((i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "json", "error"])

    return images.select("id", "content").mapInPandas(run, schema)
