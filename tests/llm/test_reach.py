"""Texts of a hot family: which of them may meet, against plain counts over all pairs."""

from __future__ import annotations

import numpy as np

from tallyloom.llm import simhash


def test_reach_loses_no_similar_pair_and_most_others(spark):
    """Copies of a text that the table lacks, next to a hub that is a copy too; some share their changes."""
    rng = np.random.default_rng(11)
    base = rng.integers(1, 2**62, 146)
    hub, sets = base.copy(), []
    hub[:10] = rng.integers(1, 2**62, 10)
    for k in range(80):
        copy = (sets[int(rng.integers(len(sets)))] if k % 4 == 3 else base).copy()
        many = int(rng.integers(3, 40))
        copy[rng.choice(len(copy), many, replace=False)] = rng.integers(1, 2**62, many)
        sets.append(copy[: int(rng.integers(120, 147))])
    inside = set(hub.tolist())
    rest = []
    for node, s in enumerate(sets):
        other = [int(x) for x in s if int(x) not in inside]
        rest.append((-1, node, node, True, len(s), len(s) - len(other), other))
    df = spark.createDataFrame(rest, "hub long, node long, label long, apart boolean, n int, same int, rest array<long>")
    every = simhash._telling(df, 0.8)
    some = simhash._reaching(every, 0.8)
    alone = {tuple(r) for r in simhash._contained(df, 0.8).collect()}
    pairs = {tuple(r) for r in simhash._within(some, 0.8).collect()} | alone
    plain = [set(s.tolist()) for s in sets]
    want = {(u, v) for u in range(80) for v in range(u + 1, 80) if len(plain[u] & plain[v]) >= 0.8 * len(plain[u] | plain[v])}
    met = {(min(u, v), max(u, v)) for g in every.groupBy("token").agg({"node": "collect_set"}).collect() for u in g[1] for v in g[1] if u != v}
    assert len(want) > 30 and want <= pairs
    assert len(pairs) < len(met) / 2


def test_reach_of_nothing(spark):
    df = spark.createDataFrame([], "hub long, node long, label long, apart boolean, n int, same int, rest array<long>")
    assert simhash._within(simhash._reaching(simhash._telling(df, 0.8), 0.8), 0.8).count() == 0
