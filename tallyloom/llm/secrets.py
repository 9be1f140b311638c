"""Secret scans in built-in functions only: fixed patterns, and a battery of randomness tests for the rest.

Candidates are runs of 20 or more characters of [A-Za-z0-9+/_-] with a letter and a digit, with a capital right after a
small letter, or of letters of one case alone. For each an encoding is inferred from its characters, and three tests ask
whether its symbols could be uniform draws: chi-squared over bins of the alphabet, Wald-Wolfowitz runs about its middle,
and lag-1 serial correlation. Letters of one case are few for bins, so there the first test asks how much likelier they
are in words than as draws. Fisher's method joins the p-values into p, uniform for true random strings and near 0 for
words, paths and names.

False discovery control: in each stratum of encoding and length, truly random strings number twice those with p above
a half, less what names put there: a share TAIL of all, halved from stratum to stratum, and twice the deviation of that
count. A stratum with fewer than LEAST of them stays shut. Whatever else lies above a threshold t is false, and the
smallest t that keeps the estimated share of false ones at ALPHA is used, so short strata with many look-alikes get a
stricter threshold than long ones.

Places of matches and what spans overlap come from running sums and maxima over arrays, which are kept by blocks so
that a text with very many matches costs as much a match as one with few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fixed patterns. Each keeps a leftmost, non-overlapping match if the stated part is long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A match takes a whole run of its class, so asking for the length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Encoding: what its strings match, its alphabet, how many symbols go into a bin.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789ABCDEF", 1),
    ("one-case", "^(?:[a-z]+|[A-Z]+)$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 4),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4),
    ("letters", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 4),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 8),
)
ALPHA = 0.05
#: Names with p above a half, as a share of all strings of the first stratum; random strings that open a stratum.
TAIL, LEAST = 0.005, 10
#: Letters in words of European languages, A to Z, in thousandths, and what each says for words.
LETTERS = (85, 14, 32, 40, 125, 18, 20, 35, 70, 3, 12, 42, 27, 72, 73, 20, 3, 66, 65, 80, 30, 14, 12, 3, 14, 5)
FOR_WORDS = tuple(math.log(26 * f / sum(LETTERS)) for f in LETTERS)
MEAN = sum(FOR_WORDS) / 26
SPREAD = math.sqrt(sum((x - MEAN) ** 2 for x in FOR_WORDS) / 26)
#: Steps of p at which thresholds lie, and the widest length stratum (lengths double from one to the next).
STEPS, LAST_STRATUM = 50, 6
MARK = "[SECRET]"


#: What a text must match for a pattern to keep anything in it; the first letter is looked at alone to get by quickly.
ASSIGN_START = r"(?=[pstaPSTA])" + ASSIGN
DIGIT, CAMEL, ONE_CASE = r"[0-9]", r"[a-z][A-Z]", r"[a-z]{20,}|[A-Z]{20,}"
#: Elements of a block of a running total.
BLOCK = 128


def flagged(docs: DataFrame, text_col: str) -> DataFrame:
    """row, the whole row of docs as a struct, with _text (null: empty) and one flag for each pattern, so that only
    few texts are searched in full."""
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return docs.withColumns(
        {
            "_has_assign": sign & F.rlike(text, F.lit(ASSIGN_START)), "_has_access": F.rlike(text, F.lit(ACCESS)),
            "_has_hex": F.rlike(text, F.lit(HEX)), "_has_random": (F.rlike(text, F.lit(DIGIT)) | F.rlike(text, F.lit(CAMEL)) | F.rlike(text, F.lit(ONE_CASE))) & F.rlike(text, F.lit(CANDIDATE)),
        }
    )


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """items in arrays of BLOCK, the last one shorter; an empty array in one."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def running(items: Column, value, join, start: int, shape: str) -> Column:
    """Structs (before, item): each item with join over start and the values of all items ahead of it.

    shape is the type of an item. Appending copies an array, so blocks of BLOCK are walked by themselves, each from
    what join gives for the blocks ahead of it.
    """
    none = F.array().cast(f"array<struct<before:int,item:{shape}>>")

    def walk(block: Column, base: Column) -> Column:
        return F.aggregate(
            block, F.struct(base.cast("int").alias("at"), none.alias("out")),
            lambda a, x: F.struct(join(a["at"], value(x)).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("before"), x.alias("item")))).alias("out")),
            lambda a: a["out"],
        )

    def walked(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(start), lambda a, x: join(a, value(x)).cast("int")))
        bases = F.aggregate(
            totals, F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, t: F.struct(join(a["at"], t).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )
        return _let(bases, lambda found: F.flatten(F.zip_with(blocks, found, walk)))

    return _let(items, lambda every: _let(_blocks(every), walked))


def located(text: Column, pattern: str, flag: str) -> Column:
    """All matches of pattern as structs (start, match), start in code points.

    What split() leaves between the matches gives the places; texts without the flag are not cut up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = _let(gaps, lambda gs: F.zip_with(F.slice(gs, F.lit(1), F.size(gs) - 1), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))))
    placed = running(pairs, lambda x: x["gap"] + F.length(x["match"]), lambda a, b: a + b, 0, "struct<gap:int,match:string>")
    starts = F.transform(placed, lambda x: F.struct((x["before"] + x["item"]["gap"]).alias("start"), x["item"]["match"].alias("match")))
    return F.when(F.col(flag), starts).otherwise(F.array().cast("array<struct<start:int,match:string>>"))


def _spans(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["match"])).alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed pattern: arrays of structs (start, kind, end)."""
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_LEAST
    return {
        "assign": _spans(F.filter(located(text, ASSIGN_START, "_has_assign"), value), "assign"),
        "access": _spans(located(text, ACCESS, "_has_access"), "access"),
        "hex": _spans(located(text, HEX, "_has_hex"), "hex"),
    }


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by a logistic form that errs by under 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def tested(token: Column) -> Column:
    """Struct (encoding, p) of a candidate string."""
    kind = F.lit(len(ENCODINGS) - 1)
    for i, (_, shape, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        kind = F.when(token.rlike(shape), F.lit(i)).otherwise(kind)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(width).alias("width")) for name, _, alphabet, width in ENCODINGS])

    def judge(e: Column) -> Column:
        plain = F.when(e["name"] == "base64", F.translate(token, "-_", "+/")).when(e["name"] == "letters", token).otherwise(F.upper(token))
        values = F.transform(F.split(plain, ""), lambda c: (F.position(c, e["alphabet"]) - 1).cast("double"))
        return F.struct(e["name"].alias("encoding"), _let(values, lambda v: _battery(v, F.length(e["alphabet"]), e["width"], e["name"] == "one-case")).alias("p"))

    return _let(F.element_at(known, kind + 1), judge)


def _battery(values: Column, symbols: Column, width: Column, letters: Column) -> Column:
    """Fisher's p of the three tests on symbol values 0 to symbols - 1; letters are judged as such."""
    says = F.array(*[F.lit(x) for x in FOR_WORDS])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    middle = symbols / 2
    pairs = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = F.transform(F.sequence(F.lit(0), (symbols / width).cast("int") - 1), lambda b: F.size(F.filter(values, lambda v: F.floor(v / width) == b)).cast("double"))

    def measure(m: Column) -> Column:
        follow = total(F.transform(m["pairs"], lambda x: (x["a"] - m["centre"]) * (x["b"] - m["centre"])))
        return F.struct(
            F.pow((m["bins"] / m["n"] * m["squares"] - m["n"]) / m["df"], 1 / 3).alias("root"), (2 / (9 * m["df"])).alias("v"),
            (2 * m["high"] * (m["n"] - m["high"]) / m["n"] + 1).alias("mean"), (m["changes"] + 1).alias("runs"), m["n"].alias("n"),
            F.when(letters, total(F.transform(values, lambda v: F.element_at(says, v.cast("int") + 1)))).otherwise(0.0).alias("words"),
            total(F.transform(values, lambda v: F.pow(v - m["centre"], 2))).alias("spread"), follow.alias("follow"),
        )

    def p_values(m: Column) -> Column:
        variance = (m["mean"] - 1) * (m["mean"] - 2) / (m["n"] - 1)
        return F.array(
            # chi-squared over bins, to a normal by Wilson and Hilferty; of letters, what they say for words
            _upper_tail(F.when(letters, (m["words"] - m["n"] * MEAN) / (SPREAD * F.sqrt(m["n"]))).otherwise((m["root"] - (1 - m["v"])) / F.sqrt(m["v"]))),
            # runs above and below the middle
            F.when(variance > 0, _two_sided((m["runs"] - m["mean"]) / F.sqrt(variance))).otherwise(0.0),
            # lag-1 serial correlation
            F.when(m["spread"] > 0, _two_sided((m["follow"] / m["spread"] + 1 / m["n"]) * F.sqrt(m["n"]))).otherwise(0.0),
        )

    first = F.struct(
        F.size(values).cast("double").alias("n"), F.size(counts).cast("double").alias("bins"), (F.size(counts) - 1).cast("double").alias("df"),
        total(F.transform(counts, lambda c: c * c)).alias("squares"), F.size(F.filter(values, lambda v: v >= middle)).cast("double").alias("high"),
        F.size(F.filter(pairs, lambda x: (x["a"] >= middle) != (x["b"] >= middle))).cast("double").alias("changes"),
        (total(values) / F.size(values)).alias("centre"), pairs.alias("pairs"),
    )
    # Fisher: h is half of a chi-squared statistic of 6 degrees
    h = _let(first, lambda m: _let(measure(m), lambda k: -total(F.transform(p_values(k), lambda p: F.log(F.greatest(p, F.lit(1e-12)))))))
    return _let(h, lambda x: F.exp(-x) * (1 + x + x * x / 2))


def candidates(text: Column) -> Column:
    """Array of structs (start, end, encoding, p, stratum) of the strings that the tests judge."""
    mixed = lambda m: m["match"].rlike(DIGIT) & m["match"].rlike("[A-Za-z]") | m["match"].rlike(CAMEL) | m["match"].rlike("^(?:[a-z]+|[A-Z]+)$")

    def row(m: Column) -> Column:
        n = F.length(m["match"])
        stratum = F.least(F.lit(LAST_STRATUM), F.floor(F.log2(n / F.lit(20.0))).cast("int"))
        return _let(tested(m["match"]), lambda t: F.struct(m["start"].alias("start"), (m["start"] + n).alias("end"), t["encoding"].alias("encoding"), t["p"].alias("p"), stratum.alias("stratum")))

    return F.transform(F.filter(located(text, CANDIDATE, "_has_random"), mixed), row)


def thresholds(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA) -> dict[tuple[str, int], float]:
    """The smallest accepted p for each encoding and length stratum, from the whole corpus.

    Counts are summed in Spark; at most encodings x strata rows come to the driver. A stratum without a threshold that
    meets alpha has no entry.
    """
    judged = flagged(docs.select(text_col), text_col).where("_has_random").select(candidates(F.col("_text")).alias("cs"))
    c = judged.select(F.explode_outer("cs").alias("c")).where("c is not null").select("c.encoding", "c.stratum", F.least(F.lit(STEPS - 1), F.floor(F.col("c.p") * STEPS).cast("int")).alias("step"))
    counts = c.groupBy("encoding", "stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("encoding", "stratum")
    above = F.sum("n").over(w.orderBy(F.desc("step")))
    names = F.sum("n").over(w) * (TAIL / F.pow(F.lit(2.0), F.col("stratum")))  # that names would put above a half if all were names
    random = 2 * (F.sum(F.when(F.col("step") >= STEPS // 2, F.col("n")).otherwise(0)).over(w) - names - 2 * F.sqrt(names))
    random = F.when(random >= LEAST, random).otherwise(0.0)
    t = F.col("step") / F.lit(float(STEPS))
    false = F.greatest(F.lit(0.0), above - random * (1 - t)) / above
    best = counts.select("encoding", "stratum", t.alias("t"), false.alias("false")).where(F.col("false") <= alpha).groupBy("encoding", "stratum").agg(F.min("t").alias("t"))
    return {(r["encoding"], r["stratum"]): r["t"] for r in best.collect()}


def scan(docs: DataFrame, text_col: str = "text", limits: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """row, the whole row of docs, with _assign, _access, _hex and _random: arrays of structs (start, kind, end), ends
    exclusive.

    Null texts are empty and have no spans; a random span that meets a fixed one is left out. Rows are independent of
    each other but for the thresholds.
    """
    limits = thresholds(docs, text_col) if limits is None else limits
    text = F.col("_text")
    base = base_spans(text)
    out = flagged(docs, text_col).withColumns({f"_{k}": v for k, v in base.items()}).withColumn("_candidates", candidates(text))
    passed = F.filter("_candidates", lambda c: c["p"] >= _limit(c, limits))
    drawn = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return out.withColumn("_drawn", drawn).withColumn("_random", _clear(F.concat("_assign", "_access", "_hex"), F.col("_drawn"))).select("row", "_text", *[f"_{k}" for k in KINDS])


SPAN = "struct<start:int,kind:int,end:int>"


def _clear(base: Column, drawn: Column) -> Column:
    """The spans of drawn that meet none of base: none that starts ahead reaches into them, none starts within."""
    is_base = lambda x: x["kind"] != KINDS.index("random")
    forward = lambda a: running(a, lambda x: F.when(is_base(x), x["end"]).otherwise(0), F.greatest, 0, SPAN)
    clear_ahead = lambda a: F.transform(F.filter(forward(a), lambda x: is_base(x["item"]) | (x["before"] <= x["item"]["start"])), lambda x: x["item"])
    back = lambda a: running(F.reverse(a), lambda x: F.when(is_base(x), x["start"]).otherwise(2**31 - 1), F.least, 2**31 - 1, SPAN)
    clear_within = lambda a: F.transform(F.filter(back(a), lambda x: ~is_base(x["item"]) & (x["before"] >= x["item"]["end"])), lambda x: x["item"])
    every = lambda d: _let(F.array_sort(F.concat(base, d)), lambda a: _let(clear_ahead(a), clear_within))
    return F.when((F.size(base) > 0) & (F.size(drawn) > 0), F.reverse(_let(drawn, every))).otherwise(drawn)


def _limit(c: Column, limits: dict[tuple[str, int], float]) -> Column:
    out = F.lit(2.0)
    for (encoding, stratum), t in sorted(limits.items()):
        out = F.when((c["encoding"] == encoding) & (c["stratum"] == stratum), F.lit(float(t))).otherwise(out)
    return out


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    A null text is empty and has no spans. Rows are handled each by itself, so repeated rows and rows without an id
    have a row each; equal texts have equal spans. An empty table gives no rows, further columns are not looked at.
    """
    found = scan(docs.select("doc_id", "text"))
    base = F.concat("_assign", "_access", "_hex")
    return found.select(
        "row.doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.concat(base, F.col("_random"))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every found span of text replaced by mark; overlapping spans are replaced together.

    Null texts stay null, and texts without spans stay as they are. Rows are handled each by itself, so repeated rows
    and rows without an id keep their places; an empty table gives no rows.
    """
    found = scan(docs)
    spans = F.array_sort(F.concat("_assign", "_access", "_hex", "_random"))
    text = F.col("_text")
    ahead = F.filter(running(F.col("_spans"), lambda x: x["end"], F.greatest, 0, SPAN), lambda x: x["item"]["start"] >= x["before"])
    between = F.transform(ahead, lambda x: F.struct(x["before"].alias("a"), x["item"]["start"].alias("b")))
    last = F.struct(F.array_max(F.transform("_spans", lambda x: x["end"])).alias("a"), F.length(text).alias("b"))

    def pieces(block: Column) -> Column:
        # substr() walks from the front, so each block's part of the text is taken once and its pieces from that
        first, to = F.element_at(block, 1)["a"], F.element_at(block, -1)["b"]
        return _let(text.substr(first + 1, to - first), lambda t: F.transform(block, lambda x: t.substr(x["a"] - first + 1, x["b"] - x["a"])))

    parts = _let(F.concat(between, F.array(last)), lambda a: F.flatten(F.transform(_blocks(a), pieces)))
    cleaned = F.when(F.size("_spans") > 0, F.array_join(parts, mark)).otherwise(F.col("row.text"))
    columns = [F.col(f"row.`{c}`") if c != "text" else F.col("_clean").alias("text") for c in docs.columns]
    return found.withColumn("_spans", spans).withColumn("_clean", cleaned).select(*columns)
