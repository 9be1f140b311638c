"""Packing documents into sequences of CAPACITY tokens by large-item matching and best fit.

Items are told apart by length alone, so the whole plan is made from a histogram of at most CAPACITY lengths: large
items, over a third of the capacity, go at most two to a bin, each with the largest partner that still fits; smaller
ones, longest first, go into the smallest gap that holds them. All steps move whole counts at once, so the plan's size
depends on the capacity and not on the corpus. A document then finds its place from its rank among those of its length.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut
from tallyloom.llm.sharding import numbered

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoding(name: str = VOCABULARY):
    """The vocabulary's encoder. Its ranks and its JSON hold the same merges, and give the same ids; the former is
    several times faster. Special tokens stand in the JSON only; texts that spell one have its id."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), "rb") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def tokenizer(name: str = VOCABULARY):
    """The vocabulary's slower encoder, left at its defaults but for special tokens at the ends, which it does not add."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def ids_of(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of a text. The fast encoder gives up on very long runs of white space; such a text goes to the other."""
    try:
        return encoding(vocabulary).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:
        return np.array(tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, "<u4")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut only if over capacity.

    The first piece of a long document takes what its full pieces leave. A null text is empty and has the end id only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for doc_id, text in zip(df["doc_id"].tolist(), df["text"], strict=True):
                ids = np.append(ids_of(text or "", vocabulary), np.array([END], "<u4"))
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = made["doc_id"].map(lambda x: None if pd.isna(x) else int(x)).astype("Int64")
            yield made

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Bin patterns (count, lengths) that use up the counts of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: list[tuple[int, tuple[int, ...]]] = []
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1  # the largest that fits beside n
        mate = large[at] if at >= 0 else None
        if mate is None or mate == n and left[n] == 1:
            mate = large[at - 1] if mate == n and at >= 1 else None
        if mate is None:
            bins.append((left.pop(n), (n,)))
            large.pop()
            continue
        many = left[n] // 2 if mate == n else min(left[n], left[mate])
        bins.append((many, (n, mate)))
        for x in (n, mate):
            left[x] -= many
            if not left[x]:
                del left[x]
                large.remove(x)
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []

    def add(gap: int, bin_: tuple[int, tuple[int, ...]]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append(bin_)

    for count, items in bins:
        add(capacity - sum(items), (count, items))
    heap = [-n for n in left]
    heapq.heapify(heap)
    while heap:
        n = -heapq.heappop(heap)
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                add(capacity, (-(-left[n] // (capacity // n)), ()))  # new bins, as many as these items need
                continue
            gap = order[at]
            count, items = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            # as many of this length in each bin as fit: best fit would return to the same bins, now the tightest
            each = min(gap // n, max(1, left[n] // count))
            many = min(count, left[n] // each)
            add(gap - each * n, (many, items + (n,) * each))
            if count > many:
                add(gap, (count - many, items))
            left[n] -= many * each
    return [b for found in gaps.values() for b in found]


def _layout(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of its runs of places, and each run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for count, items in bins:
        offset = 0
        for n in items:
            runs.setdefault(n, []).append((used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        base += count
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rs, strict=True)) for n, rs in runs.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces with sequence_id and offset: places without gaps from 0 in sequences of at most capacity tokens.

    cut_pieces must give the same rows whenever it is read. At most capacity counts come to the driver.
    """
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = _layout(plan(counts, capacity))
    ranked = numbered(cut_pieces, "length", ["doc_id", "piece", "ids_crc32"], "doc_id", sum(counts.values()), "_rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            at = lengths == n
            first, base, offset = layout[int(n)]
            run = np.searchsorted(first, ranks[at], "right") - 1
            out[at, 0] = base[run] + ranks[at] - first[run]
            out[at, 1] = offset[run]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_at", place("length", "_rank")).select(*cut_pieces.columns, "_at.sequence_id", "_at.offset")


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Rows that share an id are packed each for itself, rows without one too; a null or empty text is its end id alone.
    An empty table gives no rows, and further columns are not looked at.
    """
    return pack(cut(pieces(docs, capacity), "pieces"), capacity)
