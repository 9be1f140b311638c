"""Vector codes: integer vectors in four parts, each named by the nearest entry of its codebook.

The nearest entry is found by segment means. A part of d components cut into blocks of s has block sums S and a residual
norm r, that of what is left of it once each block's mean is taken away. For a part x and an entry y

    |x - y|^2  =  sum of (S_x - S_y)^2 / s  +  |res_x - res_y|^2  >=  sum of (S_x - S_y)^2 / s  +  (r_x - r_y)^2

so entries whose bound, at one block and then at ever smaller ones, is above the exact distance of some entry are out.
The bounds are in floating point with a margin above their rounding; what survives them gets exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are held against a codebook at a time, which bounds a task's memory.
CHUNK = 2048


def limit(dim: int) -> int:
    """Components beyond this either way are set to it, so that sums of dim squared differences stay within a long."""
    return 1 << (60 - max(1, dim).bit_length()) // 2


def edges(dim: int, parts: int = PARTS) -> list[int]:
    """Where parts begin and end; they differ by one component where dim is no multiple of parts."""
    return [dim * i // parts for i in range(parts + 1)]


class Segments:
    """Block sums, each over the root of its size, and residual norms of rows: one block, then four times as many until
    blocks would be shorter than two components."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.squares = (rows.astype(np.float64) ** 2).sum(1)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        d, blocks = rows.shape[1], 1
        while blocks == 1 or 2 * blocks <= d:
            at = np.array([d * i // blocks for i in range(blocks + 1)])
            sizes = np.diff(at).astype(np.float64)
            scaled = np.add.reduceat(rows, at[:-1], axis=1).astype(np.float64) / np.sqrt(sizes) if d else np.zeros((len(rows), 1))
            residual = np.sqrt(np.maximum(0.0, self.squares - (scaled**2).sum(1)))
            self.levels.append((scaled, residual, sizes))
            blocks *= 4


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For integer rows x: index of the nearest row of book, ties to the lower, its squared distance, and how many rows
    of book were left to measure exactly."""
    code, error, kept = (np.empty(len(x), np.int64) for _ in range(3))
    if not len(x):
        return code, error, kept
    entries = Segments(book)
    top = entries.squares.max()
    for a in range(0, len(x), CHUNK):
        part = Segments(x[a : a + CHUNK])
        n = len(part.rows)
        margin = 1.0 + 1e-9 * (part.squares + top)
        (sx, rx, _), (sy, ry, _) = part.levels[0], entries.levels[0]
        bound = (sx - sy.T) ** 2 + (rx[:, None] - ry[None, :]) ** 2
        best = _exact(part.rows, book[bound.argmin(1)])
        row, entry = np.nonzero(bound <= (best + margin)[:, None])
        for (sx, rx, _), (sy, ry, _) in zip(part.levels[1:], entries.levels[1:], strict=True):
            finer = (rx[row] - ry[entry]) ** 2
            for k in range(sx.shape[1]):
                finer += (sx[row, k] - sy[entry, k]) ** 2
            # a better known entry for each row: the first of the lowest bound
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.repeat(np.minimum.reduceat(finer, first), np.diff(np.r_[first, len(row)]))
            pick = np.flatnonzero(finer == low)
            pick = pick[np.r_[True, row[pick][1:] != row[pick][:-1]]]
            best = np.minimum(best, _exact(part.rows, book[entry[pick]]))
            stays = finer <= (best + margin)[row]
            row, entry = row[stays], entry[stays]
        exact = _exact(part.rows[row], book[entry])
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        many = np.diff(np.r_[first, len(row)])
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == np.repeat(least, many))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # entries ascend within a row
        code[a : a + n], error[a : a + n], kept[a : a + n] = entry[hit], least, many
    return code, error, kept


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def whole(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and ints of the rows whose vector is neither null nor holds null or non-finite components."""
    e = F.col("embedding")
    # in one column, so that a vector is looked at only where there is one
    sound = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(e, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-1e15)), F.lit(1e15))).cast("long"))
    return embeddings.where(sound).select("vec_id", "label", ints.alias("ints"))


def dimension(vectors: DataFrame) -> int:
    """The commonest number of components, the larger at a tie; 0 without rows."""
    top = vectors.groupBy(F.size("ints").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def learned(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part of vectors with dim components, whose ints are within limit(dim).

    Starts from the rows of the smallest vec_ids, equal ones by their components and rows without one last. Every round
    is one pass: tasks add up their parts by entry, and sums of at most parts * entries rows come to the driver.
    """
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dim)
    at = edges(dim, parts)
    books = [start[:, a:b].copy() for a, b in zip(at, at[1:], strict=False)]
    width = max(1, *(b - a for a, b in zip(at, at[1:], strict=False)))
    schema = "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(width))

    def sums(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(b), width + 1), np.int64) for b in books]
            for batch in batches:
                x = _ints(batch.column(0), dim)
                for p, book in enumerate(books):
                    mine = x[:, at[p] : at[p + 1]]
                    code = nearest(mine, book)[0]
                    order = np.argsort(code, kind="stable")
                    used, begin = np.unique(code[order], return_index=True)
                    if len(used):
                        total[p][used, 1 : 1 + mine.shape[1]] += np.add.reduceat(mine[order], begin, axis=0)
                        total[p][used, 0] += np.diff(np.r_[begin, len(code)])
            part = np.repeat(np.arange(len(books), dtype=np.int32), [len(b) for b in books])
            entry = np.concatenate([np.arange(len(b), dtype=np.int32) for b in books])
            rows = np.concatenate(total)
            seen = rows[:, 0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(part[seen]), pa.array(entry[seen]), *(pa.array(c) for c in rows[seen].T.copy())], names=["part", "entry", "n", *(f"s{k}" for k in range(width))])

        return run

    for _ in range(rounds):
        added = vectors.select("ints").mapInArrow(sums(books), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(f"s{k}") for k in range(width))).alias("s"))
        for r in added.collect():
            book = books[r["part"]]
            book[r["entry"]] = np.array([s // r["n"] for s in r["s"][: book.shape[1]]], np.int64)
    return books


def coded(vectors: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (indexes in order of parts) and error of every row; both null for rows of another length."""
    at = edges(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.array([n == dim for n in pc.list_value_length(batch.column("ints")).to_pylist()], bool)
            x = _ints(batch.column("ints").filter(pa.array(fits)), dim)
            codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                codes[:, p], e, _ = nearest(x[:, at[p] : at[p + 1]], book)
                error += e
            code, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
            code[fits] = _rows(codes)
            errors[fits] = error
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.list_(pa.int32())), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    ids = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.select("vec_id", "label").schema]
    return vectors.select("vec_id", "label", "ints").mapInArrow(run, ", ".join([*ids, "code array<int>", "error long"]))


def _rows(codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(codes), object)
    for i, c in enumerate(codes.tolist()):
        out[i] = c
    return out


def digest(books: list[np.ndarray]) -> str:
    """The sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def hexadecimal(code: Column) -> Column:
    """Indexes as two lower-case hex digits each."""
    return F.array_join(F.transform(code, lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")


def compressed(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a sound vector.

    Rows of another length than the commonest have null code and error and add nothing to their label's. Rows that
    repeat are coded each for itself; a null label is one label; a label whose errors exceed a long has a null sum.
    Components are held to limit(dim), far beyond those of embeddings. An empty table gives no rows; further columns are
    not looked at.
    """
    vectors = whole(embeddings)
    vectors = cut(vectors, "ints")  # read seven times
    dim = dimension(vectors)
    most = limit(dim)
    held = vectors.withColumn("ints", F.transform("ints", lambda x: F.least(F.greatest(x, F.lit(-most)), F.lit(most))))
    books = learned(held.where(F.size("ints") == dim), dim)
    out = cut(coded(held, dim, books), "codes")
    totals = out.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    joined = out.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", hexadecimal(F.col("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
