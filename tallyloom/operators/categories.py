"""Guessing a line's category from words in its name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories in order, with the words that point to them.
WORDS = {
    "livsmedel": ("mat", "livsmedel"),
    "frukt-gront": ("banan", "äpple", "apelsin", "tomat", "gurka", "sallad", "potatis", "lök", "morot", "paprika", "avokado", "citron", "vindruvor", "melon", "broccoli", "champinjon"),
    "mejeri": ("mjölk", "mellanmjölk", "grädde", "yoghurt", "fil", "smör", "ost", "ägg", "kvarg", "creme fraiche", "crème fraîche", "margarin"),
    "brod": ("bröd", "limpa", "frallor", "knäckebröd", "bulle", "kaka", "tortilla", "baguette"),
    "kott-fisk": ("kyckling", "köttfärs", "fläsk", "nöt", "korv", "bacon", "skinka", "lax", "torsk", "räkor", "fisk", "falukorv", "kassler"),
    "skafferi": ("pasta", "ris", "mjöl", "socker", "salt", "olja", "krossade tomater", "bönor", "linser", "müsli", "flingor", "havregryn", "ketchup", "senap", "buljong"),
    "fryst": ("fryst", "glass", "pizza", "pommes"),
    "dryck": ("läsk", "juice", "vatten", "kaffe", "te", "saft", "cola", "öl", "cider", "energidryck"),
    "godis-snacks": ("godis", "choklad", "chips", "nötter", "lösgodis", "kex"),
    "hushall": ("toapapper", "hushållspapper", "disk", "tvättmedel", "sopsäck", "rengöring", "aluminiumfolie", "plastpåsar"),
    "hygien": ("schampo", "tvål", "tandkräm", "deodorant", "blöjor", "bindor", "tandborste", "alvedon", "plåster"),
    "pant": ("pant",),
    "transport": ("bensin", "diesel", "drivmedel", "biljett"),
}


def guess(search_name: Column, words: dict[str, tuple[str, ...]] = WORDS) -> Column:
    """The category whose longest word the name contains, the first of equally long ones; null if none."""
    ranked = sorted(((w, slug) for slug, ws in words.items() for w in ws), key=lambda x: -len(x[0]))  # stable
    hits = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(s).alias("s")) for w, s in ranked]), lambda k: F.contains(search_name, k["w"]))
    return F.try_element_at(hits, F.lit(1))["s"]


#: Bytes of words that one automaton holds; a larger dictionary is searched for in several passes over the names.
PASS_BYTES = 16_000_000
_automata: dict[str, tuple] = {}


def _automaton(key: str, words: list[tuple[str, str | None, int]]):
    """The automaton of a part of the dictionary, which a worker builds once and keeps for its next tasks."""
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        best: dict[str, tuple] = {}
        for word, slug, position in words:
            if word not in best or position < best[word][0]:
                best[word] = (position, slug)
        made = ahocorasick.Automaton()
        for word, (position, slug) in best.items():
            made.add_word(word, (len(word), -position, slug))
        made.make_automaton()
        _automata[key] = (made, len(best))
    return _automata[key]


def guess_in(names: DataFrame, dictionary: DataFrame, column: str = "search_name", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """names with slug, by a dictionary (word, slug, position) of any size: that of the longest word which the name
    contains anywhere, the first by position of equally long ones; null if it contains none.

    Names run once through an automaton of all words, whatever their number and length, so words of several tokens and
    parts of a token are found alike. Null names contain nothing, and empty or null words count for nothing.
    """
    sound = dictionary.where(F.length("word") > 0).select("word", "slug", F.col("position").cast("long").alias("position"))
    size = sound.agg(F.sum(F.octet_length("word") + F.coalesce(F.octet_length("slug"), F.lit(0)) + 8)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    out = names.withColumn("_best", F.lit(None).cast("struct<size:int,first:long,slug:string>"))
    for k in range(passes):
        part = sound if passes == 1 else sound.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == k)
        out = out.withColumn("_best", F.greatest("_best", _longest([tuple(r) for r in part.collect()])(F.col(column))))
    return out.withColumn("slug", F.col("_best.slug")).drop("_best")


def _longest(words: list[tuple[str, str | None, int]]):
    key = f"{len(words)}-{hash(tuple(words))}"

    @F.pandas_udf("struct<size:int,first:long,slug:string>")
    def longest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made, n = _automaton(key, words)
        for batch in batches:
            rows = [max((hit for _, hit in made.iter(name)), key=lambda h: h[:2], default=None) if n and isinstance(name, str) else None for name in batch]
            got = pd.DataFrame([r or (None, None, None) for r in rows], columns=["size", "first", "slug"])
            yield got.astype({"size": "Int32", "first": "Int64", "slug": object})

    return lambda c: F.when(c.isNotNull(), longest(c))


def guess_by(items: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """keys and slug of the items that a word of the dictionary stands in; see guess_in."""
    return guess_in(items.select(*keys, "search_name"), dictionary).where(F.col("slug").isNotNull()).select(*keys, "slug")
