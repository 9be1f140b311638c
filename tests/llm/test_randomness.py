"""The randomness battery and its thresholds against plain Python; names alone open nothing, letters of one case are told."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import secrets

WORDS = (
    "thing count value error table window index user name reader buffer stream handler factory message parser token builder service config manager update default remote local queue worker"
    " batch column record schema import export client server request response header cookie session thread module package version number string object method array"
).split()


def upper(z):
    z = max(-8.0, min(8.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))


def plain_p(token):
    name, _, alphabet, width = next(e for e in secrets.ENCODINGS if re.search(e[1], token))
    text = token.translate(str.maketrans("-_", "+/")) if name == "base64" else token if name == "letters" else token.upper()
    v = [alphabet.index(c) for c in text]
    n, k = len(v), len(alphabet)
    bins = int(k / width)
    counts = Counter(x // width for x in v)
    df, chi = bins - 1, sum(counts[b] ** 2 for b in range(bins)) * bins / n - n
    if name == "one-case":
        a = upper((sum(secrets.FOR_WORDS[x] for x in v) - n * secrets.MEAN) / (secrets.SPREAD * math.sqrt(n)))
    else:
        w = 2 / (9 * df)
        a = upper(((chi / df) ** (1 / 3) - (1 - w)) / math.sqrt(w))
    high = sum(x >= k / 2 for x in v)
    runs = 1 + sum((x >= k / 2) != (y >= k / 2) for x, y in zip(v, v[1:], strict=False))
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    b = min(1.0, 2 * upper(abs((runs - mean) / math.sqrt(var)))) if var > 0 else 0.0
    c = sum(v) / n
    spread = sum((x - c) ** 2 for x in v)
    r = sum((x - c) * (y - c) for x, y in zip(v, v[1:], strict=False)) / spread if spread else 0
    s = min(1.0, 2 * upper(abs((r + 1 / n) * math.sqrt(n)))) if spread else 0.0
    h = -sum(math.log(max(p, 1e-12)) for p in (a, b, s))
    return name, math.exp(-h) * (1 + h + h * h / 2)


def strings(rng):
    out = []
    for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"):
        out += ["".join(rng.choice(list(alphabet), int(rng.integers(20, 90)))) for _ in range(20)]
    return [*out, *("".join(w.title() for w in rng.choice(WORDS, 5)) for _ in range(20)), "aaaaaaaaaaaaaaaaaaaaaaaa", "a1" * 20, "aaaaaaaaaaaaaaaaaaaaaaB", "0" * 21 + "a"]


def test_p_is_that_of_plain_loops(spark):
    tokens = strings(np.random.default_rng(1))
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in df.select("t", secrets.tested(F.col("t")).alias("k")).collect():
        name, p = plain_p(r["t"])
        assert r["k"]["encoding"] == name and abs(r["k"]["p"] - p) < 1e-6


def plain_thresholds(tokens):
    by = {}
    for t in tokens:
        name, p = plain_p(t)
        by.setdefault((name, min(secrets.LAST_STRATUM, int(math.log2(len(t) / 20)))), []).append(min(secrets.STEPS - 1, int(p * secrets.STEPS)))
    out = {}
    for (name, stratum), steps in by.items():
        z = len(steps) * secrets.TAIL / 2**stratum
        random = 2 * (sum(s >= secrets.STEPS // 2 for s in steps) - z - 2 * math.sqrt(z))
        random = random if random >= secrets.LEAST else 0.0
        for s in sorted(set(steps)):
            t, above = s / secrets.STEPS, sum(x >= s for x in steps)
            if max(0.0, above - random * (1 - t)) / above <= secrets.ALPHA:
                out[name, stratum] = t
                break
    return out


def test_thresholds_are_those_of_plain_counts(make):
    rng = np.random.default_rng(5)
    tokens = [t for _ in range(4) for t in strings(rng) if re.search("[0-9]", t) and re.search("[A-Za-z]", t) or re.search("[a-z][A-Z]", t) or re.fullmatch("[a-z]+|[A-Z]+", t)]
    docs = make([(i, f"x {t} y", "s") for i, t in enumerate(tokens)])
    got, want = secrets.thresholds(docs), plain_thresholds(tokens)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) >= 5


def found(make, tokens):
    return [r["doc_id"] for r in secrets.secrets(make([(i, f"see {t} here", "s") for i, t in enumerate(tokens)])).collect() if "random" in r["spans"]]


def test_names_alone_open_nothing(make):
    rng = np.random.default_rng(3)
    camel = ["".join(w if not k else w.title() for k, w in enumerate(rng.choice(WORDS, int(rng.integers(4, 8))))) for _ in range(2000)]
    long_words = ["".join(rng.choice(WORDS, int(rng.integers(4, 8)))) for _ in range(1000)]
    assert found(make, camel + [w for w in long_words if len(w) >= 20]) == []


def test_letters_of_one_case_are_told_from_words(make):
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    keys = ["".join(rng.choice(letters, 40)) for _ in range(200)] + ["".join(rng.choice(letters, 40)).upper() for _ in range(50)]
    words = ["".join(rng.choice(WORDS, 7))[:40] for _ in range(600)]
    hit = found(make, keys + words)
    true, false = sum(i < 250 for i in hit), sum(i >= 250 for i in hit)
    assert true >= 200 and false <= 0.1 * len(hit)
