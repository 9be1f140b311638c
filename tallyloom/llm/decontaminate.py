"""Benchmark passages in documents: windows of ten words of every item, searched by Wu-Manber in the documents' words.

Words are made of bytes: A-Z become small, all other ASCII bytes but digits and letters part words, and any byte above
ASCII belongs to one. With single blanks around them a window occurs among a document's words where its bytes occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut
from tallyloom.llm.wumanber import Matcher

WINDOW = 10
#: The pattern of a word in a text whose A-Z are small already.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of windows and item ids that are searched for in one pass over the documents; passes that go one after the
#: other before their findings are written down; bytes of text that a task searches at a time.
PASS_BYTES, PASSES, CHUNK = 8_000_000, 8, 4_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: bytes | None) -> bytes:
    """The words of a text with one blank before, between and after them; empty if there are none."""
    words = (text or b"").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (window, item) pairs: every run of width words of an item's text, or all its words if it has fewer.

    A null text has no words; an item without an id is called null. Items with one id are one item.
    """
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - (width - 1)))
    each = rows.select("item", "_words", F.explode(starts).alias("_at"))
    return each.select(F.array_join(F.slice("_words", F.col("_at"), F.lit(width)), " ").alias("window"), "item").distinct()


def _searched(found: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """found(doc_id, _text, n_words, _spans, _items) with what these windows add."""
    strings: dict[str, int] = {}
    of: list[list[str]] = []
    for window, item in pairs:
        k = strings.setdefault(window, len(strings))
        if k == len(of):
            of.append([])
        of[k].append(item)
    patterns = [f" {w} ".encode() for w in strings]
    lengths = np.array([p.count(b" ") - 1 for p in patterns], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(patterns)
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            texts = columns["_text"].to_pylist()
            old = zip(columns["_spans"].to_pylist(), columns["_items"].to_pylist(), strict=True)
            n_words, spans, items = [], [], []
            at = 0
            while at < len(texts):
                made, size = [], 0
                while at < len(texts) and size < CHUNK:
                    made.append(normal(texts[at]))
                    size += len(made[-1]) + 1
                    at += 1
                joined = b"\0".join(made)
                places, which = matcher.find(joined)
                order = np.argsort(places, kind="stable")
                places, which = places[order], which[order]
                blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                starts = np.cumsum([0, *(len(x) + 1 for x in made)])
                first_blank = np.searchsorted(blanks, starts)
                doc = np.searchsorted(places, starts)
                word = np.searchsorted(blanks, places)  # the blank that an occurrence begins with, one before each word
                for k in range(len(made)):
                    total = max(0, int(first_blank[k + 1] - first_blank[k]) - 1)
                    here = slice(doc[k], doc[k + 1])
                    before, known = next(old)
                    begin = word[here] - first_blank[k]
                    n_words.append(total)
                    spans.append(merged(before, begin, begin + lengths[which[here]]))
                    items.append(sorted({*known, *(i for w in set(which[here].tolist()) for i in of[w])}))
            columns |= {"n_words": pa.array(n_words, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], names=batch.schema.names)

    return found.mapInArrow(run, found.schema)


def merged(before: Sequence[int], begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Disjoint spans (begin, end, begin, end and so on, ascending) of all that the given spans cover."""
    if not len(begin):
        return list(before)
    begin, end = np.concatenate([begin, before[::2]]).astype(np.int64), np.concatenate([end, before[1::2]]).astype(np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return np.stack([begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]], axis=1).ravel().tolist()


def found(docs: DataFrame, items: DataFrame, width: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, spans (first and end word of each covered run, in turn) and item_ids (sorted strings) of every row.

    Windows go to the tasks in passes of about pass_bytes, one search of all documents each, so that neither the driver
    nor a task holds more of them whatever the number of items; most collections need one pass. Null and empty texts
    have no words and no spans; rows that repeat are searched each for itself; without items nothing is found. Further
    columns are not looked at.
    """
    pairs = cut(windows(items, width), "windows")
    size = pairs.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    out = docs.select(
        "doc_id", F.col("text").cast("binary").alias("_text"), F.lit(None).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("_items"),
    )
    for k in range(passes):
        part = pairs if passes == 1 else pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k)
        out = _searched(out, [tuple(r) for r in part.select("window", "item").collect()])
        if k % PASSES == PASSES - 1 and k + 1 < passes:
            out = cut(out, "searched")
    return out.select("doc_id", "n_words", F.col("_spans").alias("spans"), F.col("_items").alias("item_ids"))


def covered(spans: Column) -> Column:
    """How many words spans cover."""
    ends = F.filter(spans, lambda _, i: i % 2 == 1)
    begins = F.filter(spans, lambda _, i: i % 2 == 0)
    return F.aggregate(F.zip_with(begins, ends, lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """found() with its spans as a count and its items as a count and a digest."""
    out = found(docs, items)
    return out.select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
