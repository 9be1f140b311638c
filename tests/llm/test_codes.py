"""Bounds and nearest entries against all distances, and codes and codebooks against plain rounds."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import codes

VECTOR = "vec_id long, embedding array<float>, label int"


def all_distances(x, book):
    d = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(2)
    code = [min(range(len(book)), key=lambda e: (row[e], e)) for row in d.tolist()]
    return code, [row[c] for row, c in zip(d.tolist(), code, strict=True)]


def test_nearest_is_exact_with_ties_and_large_values():
    rng = np.random.default_rng(3)
    for dim, scale in ((16, 300), (16, 2), (7, 50), (1, 5), (2, 9), (3, codes.limit(3)), (16, codes.limit(64))):
        x = rng.integers(-scale, scale + 1, (300, dim))
        book = np.concatenate([rng.integers(-scale, scale + 1, (40, dim)), x[:20], x[:5]])
        code, error, _ = codes.nearest(x, book)
        want, least = all_distances(x, book)
        assert (code.tolist(), error.tolist()) == (want, least)


def test_bounds_filter_what_they_can():
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (256, 16))
    x = centres[rng.integers(0, 256, 3000)] + rng.integers(-20, 21, (3000, 16))
    assert codes.nearest(x, centres)[2].mean() < 4


def plain_reading(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in e], lb) for i, e, lb in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    lengths = [len(k[1]) for k in kept]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    fit = sorted((k for k in kept if len(k[1]) == dim), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    at = [dim * p // 4 for p in range(5)]
    books = [np.array([k[1][a:b] for k in fit[:entries]], np.int64).reshape(len(fit[:entries]), b - a) for a, b in zip(at, at[1:], strict=False)]
    x = np.array([k[1] for k in fit], np.int64)
    for _ in range(rounds):
        for p, book in enumerate(books):
            part = x[:, at[p] : at[p + 1]]
            code = np.array(all_distances(part, book)[0])
            for e in set(code.tolist()):
                mine = part[code == e]
                book[e] = [int(s) // len(mine) for s in mine.sum(0)]
    out, total = [], {}
    for i, v, lb in kept:
        if len(v) != dim:
            out.append([i, None, None, lb])
            continue
        best = [all_distances(np.array([v[at[p] : at[p + 1]]], np.int64), books[p]) for p in range(4)]
        error = sum(b[1][0] for b in best)
        out.append([i, "".join(f"{b[0][0]:02x}" for b in best), error, lb])
        total[lb] = total.get(lb, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted(repr((i, c, e, total.get(lb), digest)) for i, c, e, lb in out)


def vectors(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(v) for v in rng.normal(0, 0.2, dim).astype(np.float32)], int(rng.integers(0, 4))) for i in rng.permutation(n)]


def run(spark, rows):
    df = spark.createDataFrame(rows, VECTOR).repartition(3)
    for name in ("ints", "code", "error", "n", "part", "entry", "_label"):
        df = df.withColumn(name, F.lit(1))
    return codes.compressed(df)


def test_rows_against_plain_rounds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(420, 8), (3, [0.5] * 8, None), (3, [0.5] * 8, None), (None, [0.25] * 8, 1), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [nan] * 8, 1), (903, [-inf] * 8, 1),
            (904, [], 2), (905, [0.1] * 5, 9), (-7, [0.0] * 8, 2), (906, [-0.0001] * 8, 2)]
    assert sorted(repr(tuple(r)) for r in run(spark, rows).collect()) == plain_reading(rows)


def test_fewer_rows_than_entries_and_uneven_parts(spark):
    for rows in (vectors(5, 8), vectors(30, 10), vectors(9, 3), [(1, [0.5, 0.5], None)] * 4):
        assert sorted(repr(tuple(r)) for r in run(spark, rows).collect()) == plain_reading(rows)


def test_no_rows_and_no_components(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, None, 1)]).count() == 0
    assert [(r["code"], r["error"]) for r in run(spark, [(1, [], 1)]).collect()] == [("00000000", 0)]


def test_huge_components_are_held_to_the_limit(spark):
    got = run(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [3e38] * 8, 1)]).collect()
    assert {(r["vec_id"], r["error"]) for r in got} == {(1, 0), (2, 0), (3, 0)}
    assert len({r["code"] for r in got}) == 2
