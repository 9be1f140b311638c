"""Names scored in blocks against score_name one by one, common words, and which company a text is given."""

import time

import numpy as np
import pytest

from tallyloom.operators import likeness, names

SCORER = likeness.Scorer(names.CONFUSED, names.CONFUSED_COST, names.FIRST_WEIGHT, names.MISSING_WEIGHT, names.PRESENT, names.CONFIRMED)


def words(rng, n, least=1, most=12, letters="abcehilmnorstuv0159"):
    return ["".join(rng.choice(list(letters), int(rng.integers(least, most)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_score_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    brands = words(rng, 40, 2, 9) + ["a" * 53 + "b" * 9, "ab", "a", "q"]
    known = [" ".join([b, *rng.choice(["handel", "svenska", "bil", "x"], int(rng.integers(0, 4)))]) for b in brands] + [""]
    damaged = [b.translate(str.maketrans("oei", "0c1")) for b in brands]
    texts = [" ".join([*words(rng, int(rng.integers(0, 6))), d, *rng.choice(["handel", "hand", "summa", "svenskahandel"], int(rng.integers(0, 3)))]) for d in damaged] + ["", "a", "ab q"]
    n, t, score, sure, led = SCORER.hits(known, texts, [(np.arange(len(known)), np.arange(len(texts)))])
    want = {}
    for i, k in enumerate(known):
        for j, x in enumerate(texts):
            s = names.score_name(k.split(), x.split())
            if s[0] >= names.CONFIRMED:
                want[i, j] = (*s, names._best_word(k.split()[0], x.split(), x) >= names.PRESENT)
    got = {(i, j): v for i, j, *v in zip(n.tolist(), t.tolist(), score.tolist(), sure.tolist(), led.tolist(), strict=True)}
    assert len(want) > 100 and {k: tuple(v) for k, v in got.items()} == want


def test_a_common_word_costs_no_score_of_each_pair(spark):
    rng = np.random.default_rng(4)
    brands = words(rng, 700, 9, 14, "abcdefghijklmnop")
    texts = spark.createDataFrame([(i, f"Tack för besöket hos {b}! handla igen, summa 12,50 kr") for i, b in enumerate(brands)], "id long, text string")
    companies = spark.createDataFrame([(i, f"{b} Handel AB", True) for i, b in enumerate(brands)], "id long, name string, active boolean")
    began = time.perf_counter()
    got = {r["id"]: r["company_id"] for r in names.match_companies(texts, companies).collect()}
    assert got == {i: i for i in range(len(brands))}
    assert time.perf_counter() - began < 120  # 490,000 pairs one by one take ten times as long


def test_a_block_in_parts_meets_whole(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"hos abc{i:04d}xyz") for i in range(60)], "id long, text string")
    companies = spark.createDataFrame([(i, f"abc{i:04d}xyz", True) for i in range(60)], "id long, name string, active boolean")
    want = sorted(map(tuple, names.match_companies(texts, companies).collect()))
    monkeypatch.setattr(names, "BLOCK", 7)
    assert sorted(map(tuple, names.match_companies(texts, companies).collect())) == want and len(want) == 60


@pytest.mark.parametrize("intended", [False, True])
def test_a_company_by_its_first_word_goes_first(spark, intended):
    texts = spark.createDataFrame([(1, "Tack för besöket hos ham0elfradelme! Summa 12,50 kr"), (2, "nära handel")], "id long, text string")
    companies = spark.createDataFrame([(199, "okdpeekkeklndd Handel AB", True), (2385, "hamoelfkadelme Handel AB", False)], "id long, name string, active boolean")
    assert names.score_name(["okdpeekkeklndd", "handel"], "tack for besoket hos ham0elfradelme summa 12 50 kr".split())[0] == 1.0
    got = {r["id"]: r["company_id"] for r in names.match_companies(texts, companies, intended=intended).collect()}
    assert got[1] == 2385 and 2 in got  # which word a text has is enough if no company's first word is there
