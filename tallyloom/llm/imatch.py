"""I-Match fingerprints over an inverse-document-frequency band, with randomised lexicon subsets.

Terms are lower-cased words. The lexicon holds the terms in between LOW and HIGH of all documents; as a document holds
D distinct terms on average, at most D / LOW terms can be that frequent, so the lexicon's size is bounded whatever the
corpus. Each of SUBSETS random subsets of the lexicon, from half of it down to a small share, gives one hash of the
document's sorted distinct terms in it. Two texts agree in a subset if their hashes do; subsets without a term of
either do not tell. Likeness is the best rate of agreement among the shares with TELLING or more telling subsets:
dense subsets serve short texts, sparse ones long texts, in which any edit would change every dense hash.

Copies count in the frequencies like other documents, so a text that makes up a tenth of the corpus loses its own
terms from the band; so does a text of stop words or of unique words only. A second family of subsets is therefore
drawn over all terms, and two texts are compared by it if either has fewer than FEW terms in the band.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The band, as shares of documents; least documents a term is in.
LOW, HIGH, LEAST = 0.001, 0.1, 2
#: Subsets hold the share 1/2**s of the lexicon; how many there are of each share, and how many must tell.
SHARES, EACH, TELLING = (1, 3, 4, 5, 6, 7, 8, 10), 8, 3
SUBSETS = len(SHARES) * EACH
#: Band terms from which on a text is compared by them; shares of the family over all terms.
FEW, ALL_SHARES = 3, (0, 1, 3, 5)
#: Distinct terms counted in memory before a task sends its counts on.
FLUSH = 400_000
#: Rows of neighbouring ids that are matched together, and most such chunks; a chunk streams through its task.
CHUNK, CHUNKS = 500, 16_384


def terms(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").lower().split())


def _hashes(terms_: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms_, repeat(7)), "<u8", n).view("<i8")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents.

    Tasks count ahead of the shuffle; only terms of the band come to the driver, at most (mean distinct terms of a
    document) / low of them.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def made() -> pd.DataFrame:
            return pd.DataFrame({"term": _hashes(seen, len(seen)), "n": np.fromiter(seen.values(), "<i8", len(seen))})

        for df in batches:
            for t in df[text_col]:
                seen.update(terms(t))
                if len(seen) > FLUSH:
                    yield made()
                    seen.clear()
        if seen:
            yield made()

    total = docs.count()
    counted = docs.select(text_col).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") >= max(LEAST, low * total)) & (F.col("n") <= max(LEAST, high * total))).select("term")
    return np.sort(band.toPandas()["term"].to_numpy(dtype="int64"))


#: One addend for each subset of a share.
STEPS = np.array([0x9E3779B97F4A7C15 * (e + 1) & 0xFFFFFFFFFFFFFFFF for e in range(EACH)], "<u8")


def _subset_bits(hashes: np.ndarray, shares: tuple[int, ...] = SHARES) -> np.ndarray:
    """Rows of flags, one row a subset: whether each term is in it; share 1/2**s asks for s zero bits of a hash."""
    x = (hashes.view("<u8") + STEPS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    masks = np.array([(1 << s) - 1 for s in shares], "<u8")
    return ((x & masks[:, None, None]) == 0).reshape(len(shares) * EACH, len(hashes))


def _hashed(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """One hash of 32 bits for each subset of sorted terms; of no terms 0."""
    raw = memoryview(np.broadcast_to(found, bits.shape)[bits].tobytes())
    ends = (8 * np.cumsum(np.count_nonzero(bits, axis=1))).tolist()
    out, start, digest = [0] * len(bits), 0, xxhash.xxh32_intdigest
    for k, end in enumerate(ends):
        if end > start:
            out[k] = digest(raw[start:end], k) or 1
            start = end
    return np.array(out, "<u4")


@dataclass
class Fingerprint:
    """Hashes over the band's terms and over all terms, and how many of the band's there are."""

    band: np.ndarray
    every: np.ndarray
    terms: int

    def __str__(self) -> str:
        return np.concatenate([self.band, self.every]).astype(">u4").tobytes().hex()


class Matcher:
    def __init__(self, lex: np.ndarray):
        self.lex = lex
        self.bits = np.ascontiguousarray(_subset_bits(lex).T)

    def fingerprint(self, text: str | None) -> Fingerprint:
        own = terms(text)
        h = np.sort(_hashes(own, len(own)))
        at = np.searchsorted(self.lex, h)
        if len(self.lex):
            at = np.minimum(at, len(self.lex) - 1)
            at = at[self.lex[at] == h]
        else:
            at = at[:0]
        return Fingerprint(_hashed(self.lex[at], np.ascontiguousarray(self.bits[at].T)), _hashed(h, _subset_bits(h, ALL_SHARES)), len(at))


def _agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Best rate of agreement among the shares; over all telling subsets together if no share has enough of them."""
    tells = (a | b) != 0
    told = tells.reshape(-1, EACH).sum(1).tolist()
    same = (tells & (a == b)).reshape(-1, EACH).sum(1).tolist()
    best = max((x / n for x, n in zip(same, told, strict=True) if n >= TELLING), default=-1.0)
    return best if best >= 0 else sum(same) / sum(told) if sum(told) else 1.0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1; two texts without any terms are alike."""
    return _agreement(a.band, b.band) if min(a.terms, b.terms) >= FEW else _agreement(a.every, b.every)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _bounds(ids: DataFrame, rows: int) -> list[int]:
    """Ids at which chunks begin, ascending: about CHUNK rows each, or more if that made over CHUNKS of them."""
    pieces = min(CHUNKS, -(-rows // CHUNK))
    if pieces <= 1:
        return []
    at = [i / pieces for i in range(1, pieces)]
    return sorted({int(x) for x in ids.approxQuantile("doc_id", at, 0.2 / pieces)})


class Chunks:
    """Chunks of neighbouring rows in the order of descending ids, null ids last; ids with many rows have a chunk for
    each range of their texts' digests, other chunks have all rows of their ids."""

    def __init__(self, starts: list[int], hot: dict[int | None, int]):
        self.hot = hot
        self.starts = np.array(sorted({*starts, *(x for h in hot if h is not None for x in (h, h + 1))}), dtype="int64")
        pieces = [1] * (len(self.starts) + 2)
        for h, n in hot.items():
            pieces[self.place(h)] = n
        self.base = np.cumsum([0, *pieces[:-1]])

    def place(self, doc_id: int | None) -> int:
        return len(self.starts) + 1 if doc_id is None else len(self.starts) - int(np.searchsorted(self.starts, doc_id, "right"))

    def of(self, doc_id: int | None, digest: bytes) -> int:
        return int(self.base[self.place(doc_id)]) + (self.hot[doc_id] * int.from_bytes(digest[:4], "big") >> 32 if doc_id in self.hot else 0)


def _digest(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def matched(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is the next in descending doc_id, after the last the first; rows of one id go by the md5 of
    their text, null ids come last, null texts are empty. Rows are dealt into chunks of neighbouring ids; the first
    row of a chunk also goes to the chunk before, so each has all it needs, and streams through its task. An id with
    many rows, or no id, has chunks by digest, so only rows alike in id and text share one whatever their number.
    Texts travel compressed, and once. A single document is its own next one; an empty table gives no rows.
    """
    lex = lexicon(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.count()
    often = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(4 * CHUNK, total // CHUNKS)).collect()  # fewer than CHUNKS rows
    size = max(CHUNK, total // CHUNKS)
    hot = {r["doc_id"]: -(-r["n"] // size) for r in often}
    chunks = Chunks(_bounds(docs.select("doc_id").where("doc_id is not null"), total), hot)

    @F.pandas_udf("int")
    def chunk(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([chunks.of(None if pd.isna(i) else int(i), d) for i, d in zip(ids, digests, strict=True)], dtype="int32")

    # The first row of each chunk: only hot ids' texts are looked at for that.
    is_hot = F.col("doc_id").isNull() & F.lit(None in hot) | F.coalesce(F.col("doc_id").isin([h for h in hot if h is not None]), F.lit(False))
    digest = F.when(is_hot, F.unhex(F.md5(F.coalesce("text", F.lit(""))))).otherwise(F.lit(b""))
    keyed = docs.select("doc_id", digest.alias("digest")).withColumn("chunk", chunk("doc_id", "digest"))
    tops = keyed.groupBy("chunk").agg(F.max("doc_id").alias("top"), F.min("digest").alias("digest")).orderBy("chunk").collect()
    # One entry for each chunk: its first row, and the chunk that this row is also sent to.
    before = {(r["top"], bytes(r["digest"]) if r["top"] in hot else b""): tops[i - 1]["chunk"] for i, r in enumerate(tops)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zs.ZstdCompressor(level=3)
        for df in batches:
            keys = [None if pd.isna(x) else int(x) for x in df["doc_id"]]
            digests = [_digest(t) for t in df["text"]]
            packed = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in df["text"]]
            rows = [(chunks.of(k, d), 0, k, d, b) for k, d, b in zip(keys, digests, packed, strict=True)]
            firsts = [before.get((k, d if k in hot else b"")) for k, d in zip(keys, digests, strict=True)]
            rows += [(c, 1, k, d, b) for c, k, d, b in zip(firsts, keys, digests, packed, strict=True) if c is not None]
            yield pd.DataFrame(rows, columns=["chunk", "ahead", "doc_id", "digest", "body"]).astype({"doc_id": "Int64"})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, open_ = Matcher(lex), zs.ZstdDecompressor()
        last = None  # (doc_id, text, fingerprint) that waits for the next
        for df in batches:
            out = []
            for ahead, doc_id, body in zip(df["ahead"], df["doc_id"], df["body"], strict=True):
                if ahead and last is None:
                    continue  # a later row of the id that closed the chunk
                text = open_.decompress(body).decode("utf-8", "surrogatepass") if body else ""
                fp = matcher.fingerprint(text)
                if last is not None:
                    new = edited(last[1], text)
                    new_fp = matcher.fingerprint(new)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last[0], len(last[1]), digest, str(last[2]), str(new_fp), likeness(last[2], new_fp), likeness(last[2], fp)))
                last = None if ahead else (doc_id, text, fp)
            made = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
            made["doc_id"] = made["doc_id"].map(lambda x: None if pd.isna(x) else int(x)).astype("Int64")
            yield made

    dealt = docs.mapInPandas(deal, "chunk int, ahead int, doc_id long, digest binary, body binary")
    order = ["chunk", "ahead", F.desc_nulls_last("doc_id"), "digest"]
    return dealt.repartition("chunk").sortWithinPartitions(*order).mapInPandas(meet, OUT)
