"""Wu-Manber search against str.find, and hits against a plain scan over all windows."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate
from tallyloom.llm.wumanber import Matcher
from tests.llm.conftest import ODD

FEW = st.binary(max_size=400).map(lambda b: bytes(b"ab "[x % 3] for x in b))


@given(FEW, st.lists(FEW.filter(len), max_size=12, unique=True))
@settings(max_examples=200, deadline=None)
def test_every_occurrence_is_found(text, strings):
    places, which = Matcher(strings).find(text)
    want = [(i, k) for k, s in enumerate(strings) for i in range(len(text)) if text.startswith(s, i)]
    assert sorted(zip(places.tolist(), which.tolist(), strict=True)) == sorted(want)


def test_long_strings_and_lane_borders():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    cuts = [(int(a), int(n)) for a, n in zip(rng.integers(0, 50_000, 300), rng.integers(1, 9000, 300), strict=True)] + [(512 * k - 5, 10) for k in range(1, 60)]
    strings = sorted({text[a : a + n] for a, n in cuts})
    places, which = Matcher(strings).find(text)
    got = set(zip(places.tolist(), which.tolist(), strict=True))
    assert got == {(i, k) for k, s in enumerate(strings) for i in (m.start() for m in re.finditer(b"(?=" + re.escape(s) + b")", text))}


def words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def plain_reading(docs, items, width=10):
    wins = {}
    for item, text in items:
        ws = words(text)
        for s in range(max(1, len(ws) - width + 1)) if ws else ():
            wins.setdefault(tuple(ws[s : s + width]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text, _ in docs:
        ws, hit, found = words(text), set(), set()
        for k in {len(w) for w in wins}:
            for s in range(len(ws) - k + 1):
                if (w := tuple(ws[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    found |= wins[w]
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here"), (2, "the QUICK brown-fox, jumps over the lazy dog and hides"),
    (10, "word"), (None, "no id"), (3, None), (4, " .,- "), (5, "日本語 é"), (6, "long " * 40), (2, "other words"), (7, "the quick brown fox jumps over the lazy dog and runs far away from here"),
]
BASE = "so The quick  brown\tfox; jumps over (the) lazy dog and runs far away from HERE it goes"
DOCS = [
    *ODD, (20, BASE, "s"), (20, BASE, "s"), (21, BASE.replace("lazy", "lazier"), "s"), (22, (BASE + " ") * 300, "s"), (23, "sword words word", "s"), (24, "日本語 é 日本語é", "s"),
    (25, "the quick brown fox jumps over the lazy dog", "s"), (26, "x" * 200_000 + " word " + "y" * 100_000, "s"), (27, "a\x00word\x7fb", "s"), (28, "wordé word1 ẀORD", "s"),
]


def items_of(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1)).withColumn("item", F.lit(2))


def test_rows_against_a_plain_reading(spark, make):
    got = decontaminate.decontaminate(make(DOCS), items_of(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == plain_reading(DOCS, ITEMS)


def test_several_passes_give_the_same(spark, make):
    one = decontaminate.found(make(DOCS), items_of(spark)).collect()
    many = decontaminate.found(make(DOCS), items_of(spark), pass_bytes=60).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_empty_tables(spark, make):
    none = items_of(spark).limit(0)
    assert decontaminate.decontaminate(make([]), items_of(spark)).count() == 0
    got = decontaminate.decontaminate(make(DOCS), none).collect()
    assert sorted(map(repr, map(tuple, got))) == plain_reading(DOCS, [])


def test_words_in_spark_and_in_bytes_agree(spark):
    texts = ["Ab-c1 É_x\x85y", "  ", "ß9.ǅ", "\U0001f600A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    got = {r["item"]: r["window"] for r in decontaminate.windows(df).collect()}
    assert got == {str(i): decontaminate.normal(t.encode()).decode().strip() for i, t in enumerate(texts) if words(t)}
