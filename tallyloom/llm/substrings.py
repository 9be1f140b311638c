"""Exact substring deduplication by fixed-block anchors.

A window is WINDOW = 20 consecutive words. Any window holds a whole one of its document's non-overlapping reference
blocks of BLOCK = 10 words, so two equal windows meet twice: each one's block is met by the other's rolling window of
10 words at the same place. The job runs in two rounds.

Anchors: tasks hash every rolling window of 10 words and send the distinct hashes of a batch of documents, sorted and
packed, to hash buckets, with the batch's reference blocks. A bucket tells which blocks are met by a rolling window
other than themselves. A hash that a batch holds many times is sent once, and its blocks are known to be met at once,
so that a passage in a third of all documents costs its bucket one entry a batch.

Extension: only documents with met blocks are read again, and only windows of 20 words around such blocks are hashed,
to 128 bits; windows count as equal if those are. Both halves are made of the same 64-bit hashes of words, so the chance of a mistake is that of two words in one place having one hash.
Windows of one batch are compared there; of each distinct one the earliest goes to its bucket, where the
earliest of all is found and the rest are marked. Runs of marked windows are the maximal exact repeats; the words
they cover are removed.

Buckets grow in number with the text. A task sends to at most FANOUT ranges of them at once, and if there are more
buckets, ranges are split again in further passes, so that the rows sent stay large and their cost a hash the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

WINDOW, BLOCK = 20, 10
#: Hashes that a task sorts at a time, hashes that a bucket should hold, fewest buckets.
BATCH, BUCKET, LEAST_BUCKETS = 1_500_000, 1_500_000, 256
#: Ranges of buckets that one pass sends to, and tasks that share a range in the next one.
FANOUT, SHARED = 1024, 16
#: Stands for a null id, which thereby counts as the smallest.
NULL_ID = -(2**63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word to its 64-bit hash; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(h: np.ndarray, size: int, m: np.uint64 = _M1) -> np.ndarray:
    """Hash of every run of size word hashes: a polynomial modulo 2**64, mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= m
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _M2
    out ^= out >> np.uint64(29)
    return out


def _bytes(a: np.ndarray, width: int | None = None) -> bytes:
    """Values by byte, lowest byte of all first: sorted or small values then compress well."""
    b = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)
    return np.ascontiguousarray(b[:, :width].T).tobytes()


def _values(body: bytes, at: int, n: int, kind: str, width: int | None = None) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    width = width or size
    out = np.zeros((n, size), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel(), at + n * width


SENT = "bucket int, kind int, n int, m int, body binary"


def _runs(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that sorted hashes touch, by their highest bits; buckets is a power of two."""
    if not len(h):
        return []
    at = (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return list(zip(at[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True))


def _blocks_sent(u: np.ndarray, repeated: np.ndarray, of: np.ndarray, ids: np.ndarray, numbers: np.ndarray, buckets: int) -> list[tuple]:
    """Rows for buckets: sorted 48-bit hashes u, whether each is known to be repeated, and blocks, of[i] being the
    place in u of block i's hash, in ascending order."""
    out = []
    for b, x, y in _runs(u << np.uint64(16), buckets):
        o = slice(*np.searchsorted(of, [x, y]))
        body = _bytes(u[x:y], 6) + np.packbits(repeated[x:y]).tobytes() + _bytes((of[o] - x).astype(np.int32)) + _bytes(ids[o]) + _bytes(numbers[o])
        out.append((b, 0, y - x, o.stop - o.start, body))
    return out


def _blocks_read(n: int, m: int, body: bytes) -> tuple[np.ndarray, ...]:
    u, at = _values(body, 0, n, "<u8", 6)
    repeated = np.unpackbits(np.frombuffer(body, np.uint8, -(-n // 8), at))[:n].astype(bool)
    of, at = _values(body, at + -(-n // 8), m, "<i4")
    ids, at = _values(body, at, m, "<i8")
    numbers, _ = _values(body, at, m, "<i4")
    return u, repeated, of.astype(np.int64), ids, numbers


def _blocks_merged(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Several rows as one; a hash in two of them is repeated."""
    us, repeats, ofs, ids, numbers = zip(*rows, strict=True)
    base = np.cumsum([0, *map(len, us)])
    u, inverse = np.unique(np.concatenate(us), return_inverse=True)
    repeated = np.bincount(inverse, weights=1.0 + np.concatenate(repeats), minlength=len(u)) > 1
    of = inverse[np.concatenate([o + b for o, b in zip(ofs, base, strict=False)])]
    order = np.argsort(of, kind="stable")
    return u, repeated, of[order], np.concatenate(ids)[order], np.concatenate(numbers)[order]


def _windows_sent(columns: tuple[np.ndarray, ...], buckets: int) -> list[tuple]:
    return [(b, 0, y - x, 0, b"".join(_bytes(c[x:y]) for c in columns)) for b, x, y in _runs(columns[0], buckets)]


WINDOW_KINDS, LATE_KINDS = ("<u8", "<u8", "<i8", "<i8", "<i4"), ("<i8", "<i8", "<i4")


def _columns(n: int, body: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    at, out = 0, []
    for t in kinds:
        x, at = _values(body, at, n, t)
        out.append(x)
    return out


def _windows_merged(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Several rows as one, in the order of hashes and then of places."""
    h1, h2, i, k, p = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((p, k, i, h2, h1))
    return tuple(x[order] for x in (h1, h2, i, k, p))


def _again(buckets: int, read, merged, sent):
    """Splits the rows of ranges into finer ones; ranges come one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, held = None, [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(sent(merged(rows)), columns=["bucket", "kind", "n", "m", "body"])

        for df in batches:
            plain = df[df["kind"] == 1]
            if len(plain):
                yield plain
            for bucket, n, m, body in zip(*(df.loc[df["kind"] == 0, c] for c in ("bucket", "n", "m", "body")), strict=True):
                if rows and (bucket != now or held >= BATCH):
                    yield flush()
                    rows, held = [], 0
                now = bucket
                rows.append(read(n, m, body))
                held += n
        if rows:
            yield flush()

    return run


def _passes(sent: DataFrame, first: int, buckets: int, read, merged, send) -> DataFrame:
    """sent, whose rows are split into first ranges, with its rows split into buckets."""
    while first < buckets:
        first = min(buckets, first * FANOUT)
        share = F.pmod(F.xxhash64("n", "m", F.substring("body", 1, 16)), F.lit(SHARED))
        fine = first
        sent = sent.repartition("bucket", share).sortWithinPartitions("bucket").mapInPandas(_again(fine, read, merged, lambda x, fine=fine: send(x, fine)), SENT)
    return sent


def _probes(buckets: int):
    def flush(hashes: list[np.ndarray], ids: list[int], sizes: list[int], batch: int) -> pd.DataFrame:
        h = np.concatenate(hashes)
        size = np.array(sizes)
        start = np.cumsum(size) - size
        place = np.arange(len(h)) - np.repeat(start, size)
        aligned = np.flatnonzero(place % BLOCK == 0)
        block_h = h[aligned]
        block_id = np.repeat(np.array(ids, np.int64), size)[aligned]
        block_no = (place[aligned] // BLOCK).astype(np.int32)
        u, counts = np.unique(h >> np.uint64(16), return_counts=True)
        at = np.searchsorted(u, block_h >> np.uint64(16))
        known = counts[at] > 1
        out = []
        direct = np.flatnonzero(known)
        for i, some in enumerate(np.array_split(direct, max(1, -(-len(direct) // 20_000)))):
            if len(some):  # blocks that the batch itself has met
                out.append((-1 - (batch * 31 + i) % buckets, 1, len(some), 0, _bytes(block_id[some]) + _bytes(block_no[some])))
        open_ = np.flatnonzero(~known)
        open_ = open_[np.argsort(at[open_], kind="stable")]
        out += _blocks_sent(u, counts > 1, at[open_], block_id[open_], block_no[open_], buckets)
        return pd.DataFrame(out, columns=["bucket", "kind", "n", "m", "body"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = WordHashes()
        hashes, ids, sizes, held, batch = [], [], [], 0, 0
        for df in batches:
            for doc_id, text in zip(df["id"], df["text"], strict=True):
                w = words(text)
                if len(w) < WINDOW:
                    continue
                r = rolling(np.array([lookup[x] for x in w], np.uint64), BLOCK)
                hashes.append(r)
                ids.append(doc_id)
                sizes.append(len(r))
                held += len(r)
                batch = (batch * 1_000_003 + int(r[0])) & 0x7FFFFFFF
                if held >= BATCH:
                    yield flush(hashes, ids, sizes, batch)
                    hashes, ids, sizes, held = [], [], [], 0
        if held:
            yield flush(hashes, ids, sizes, batch)

    return run


def _met(df: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a bucket that some other rolling window equals."""
    ids, blocks, rows = [], [], []
    for kind, n, m, body in zip(df["kind"], df["n"], df["m"], df["body"], strict=True):
        if kind == 1:
            i, b = _columns(n, body, ("<i8", "<i4"))
            ids.append(i)
            blocks.append(b)
        else:
            rows.append(_blocks_read(n, m, body))
    if rows:
        _, often, of, owners, numbers = _blocks_merged(rows)
        ids.append(owners[often[of]])
        blocks.append(numbers[often[of]])
    return pd.DataFrame({"id": np.concatenate(ids), "block": np.concatenate(blocks)}) if ids else pd.DataFrame({"id": np.zeros(0, np.int64), "block": np.zeros(0, np.int32)})


def _sha(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


READ = "id long, key long, n_words long, sha string, text string, blocks array<int>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and digests of whole texts; the text goes on only where blocks are met."""
    for df in batches:
        split = [words(t) for t in df["text"]]
        out = df[["id", "key"]].assign(n_words=[len(w) for w in split], sha=[_sha(w) for w in split])
        yield out.assign(text=df["text"].where(df["blocks"].notna(), None), blocks=df["blocks"])


def _extend(buckets: int):
    """Windows around met blocks: the earliest of each kind in a batch, by bucket, and the marked rest."""

    def flush(parts: list[tuple]) -> pd.DataFrame:
        h1, h2, i, k, p = _windows_merged(parts)
        first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
        late = (i != i[lead]) | (k != k[lead]) | (p != p[lead])
        out = []
        some = np.flatnonzero(late)
        some = some[np.lexsort((p[some], k[some], i[some]))]
        for j, s in enumerate(np.array_split(some, max(1, -(-len(some) // 50_000)))):
            if len(s):
                out.append((-1 - (int(h1[0]) + j) % buckets, 1, len(s), 0, _bytes(i[s]) + _bytes(k[s]) + _bytes(p[s])))
        out += _windows_sent(tuple(x[first] for x in (h1, h2, i, k, p)), buckets)
        return pd.DataFrame(out, columns=["bucket", "kind", "n", "m", "body"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = WordHashes()
        parts, held = [], 0
        for df in batches:
            for doc_id, key, text, blocks in zip(df["id"], df["key"], df["text"], df["blocks"], strict=True):
                h = np.array([lookup[x] for x in words(text)], np.uint64)
                n = len(h) - WINDOW + 1
                if n <= 0:
                    continue
                near = np.zeros(n + BLOCK + 1, np.int32)
                blocks = np.asarray(blocks, np.int64)
                blocks = blocks[blocks * BLOCK - BLOCK < n]
                np.add.at(near, np.maximum(blocks * BLOCK - (WINDOW - BLOCK), 0), 1)
                np.add.at(near, np.minimum(blocks * BLOCK + 1, n), -1)
                p = np.flatnonzero(np.cumsum(near[:n]) > 0)
                parts.append((rolling(h, WINDOW)[p], rolling(h, WINDOW, _M2)[p], np.full(len(p), doc_id, np.int64), np.full(len(p), key, np.int64), p.astype(np.int32)))
                held += len(p)
                if held >= BATCH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _marked(df: pd.DataFrame) -> pd.DataFrame:
    """Starts of the windows of a bucket that start earlier elsewhere."""
    late, open_ = [], []
    for kind, n, body in zip(df["kind"], df["n"], df["body"], strict=True):
        (late if kind else open_).append(_columns(n, body, LATE_KINDS if kind else WINDOW_KINDS))
    if open_:
        h1, h2, i, k, p = _windows_merged(open_)
        first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
        m = (i != i[lead]) | (k != k[lead]) | (p != p[lead])
        late.append([i[m], k[m], p[m]])
    if not late:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "places": []})
    i, k, p = (np.concatenate(x) for x in zip(*late, strict=True))
    order = np.lexsort((p, k, i))
    i, k, p = i[order], k[order], p[order]
    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]) if len(i) else np.zeros(0, np.int64)
    return pd.DataFrame({"id": i[starts], "key": k[starts], "places": [x.tobytes() for x in np.split(p, starts[1:])] if len(starts) else []})


DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for doc_id, n_words, sha, text, places in zip(df["id"], df["n_words"], df["sha"], df["text"], df["places"], strict=True):
            removed = 0
            if places is not None and len(places):
                w = words(text)
                covered = np.zeros(len(w) + 1, np.int32)
                p = np.frombuffer(b"".join(places), "<i4")
                np.add.at(covered, p, 1)
                np.add.at(covered, p + WINDOW, -1)
                keep = np.cumsum(covered[:-1]) == 0
                removed, sha = int((~keep).sum()), _sha([x for x, k in zip(w, keep, strict=True) if k])
            out.append((doc_id, n_words, removed, sha))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in DONE.split(", ")])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A null text has no words; null ids count as one id below all others. Of rows that share an id the one whose text
    hash is smaller is earlier, and identical rows are the same document: neither makes the other a repeat.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = LEAST_BUCKETS
    while buckets * BUCKET * 6 < chars:
        buckets *= 2

    first = min(buckets, FANOUT)
    sent = _passes(docs.mapInPandas(_probes(first), SENT), first, buckets, _blocks_read, _blocks_merged, lambda x, fine: _blocks_sent(*x, fine))
    met = sent.groupBy("bucket").applyInPandas(_met, "id long, block int")
    blocks = cut(met.groupBy("id").agg(F.collect_set("block").alias("blocks")), "blocks")

    repeated = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # ids alone, without texts
    known = blocks.join(repeated, "id", "full")
    key = F.when(F.col("n").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    read = cut(docs.join(known, "id", "left").select("id", "text", "blocks", key.cast("long").alias("key")).mapInPandas(_read, READ), "read")
    some = read.where("blocks is not null")

    windows = _passes(some.select("id", "key", "text", "blocks").mapInPandas(_extend(first), SENT), first, buckets, lambda n, m, body: _columns(n, body, WINDOW_KINDS), _windows_merged, _windows_sent)
    marked = windows.groupBy("bucket").applyInPandas(_marked, "id long, key long, places binary")
    places = cut(marked.groupBy("id", "key").agg(F.collect_list("places").alias("places")), "places")

    joined = some.select("id", "key", "n_words", "sha", "text").join(places, ["id", "key"], "left").select("id", "n_words", "sha", "text", "places")
    rest = read.where("blocks is null").select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    done = joined.mapInPandas(_remove, DONE).unionByName(rest)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
