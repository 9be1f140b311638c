"""The pipeline against its stages in plain Python, and its rules over odd rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import toxicity
from tests.llm.conftest import ODD


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir).cache()
        out[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    clean = {r["doc_id"]: r["text"] for r in out["toxicity"]}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic - set(clean) & {r["doc_id"] for r in docs.select("doc_id").collect()}) <= max(1, len(toxic) // 20)
    # one document of each group stays: of two alike never both, and none goes that is like no other
    stay = {r["doc_id"] for r in out["simhash"]}
    shingles = {i: grams(t) for i, t in clean.items()}
    like = {i: max((len(s & o) / len(s | o) for j, o in shingles.items() if j != i), default=0) for i, s in shingles.items()}
    assert all(like[i] >= 0.8 for i in set(clean) - stay)
    kept = sorted(stay)
    assert not [(i, j) for k, i in enumerate(kept) for j in kept[k + 1 :] if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    assert {r["doc_id"] for r in out["secrets"]} == stay
    assert all(r["n_chars"] == len(r["text"]) for r in out["secrets"])
    copies = Counter(r["doc_id"] for r in out["mixing"])
    assert max(copies.values()) <= 2 and set(copies) <= stay
    assert Counter(r["doc_id"] for r in out["packing"] if r["piece"] == 0) == copies
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter((r["doc_id"], r["piece"], r["length"]) for r in out["packing"])


def test_odd_rows(spark, make, sf_dir):
    at = make(ODD)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
        assert at.count() > 0
    empty = make(ODD).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


def test_toxic_documents_go_by_words_that_few_of_them_share(spark, make):
    rng = np.random.default_rng(3)
    bits = ["an", "er", "th", "ou", "ing", "re", "st", "ble", "on", "ti", "ha", "ea", "ly", "wh", "or", "nd"]
    marks = ["wretch", "villain", "scoundrel", "rotten", "vermin", "dimwit", "foul", "ghastly"]
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(rng.choice(bits, rng.integers(1, 6))) for _ in range(120)]
        bad = i % 4 == 0
        for at in rng.integers(0, 120, 2) if bad else ():
            words[at] = str(rng.choice(marks)) + str(rng.choice(["", ".", ","]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(make(rows), known.where(~toxicity.held_out(F.col("doc_id"))))
    left = {r["doc_id"] for r in toxicity.score(make(rows), model).where(F.col("score") < corpus_pipeline.TOXIC_AT).collect()}
    held = [(i, bad) for i, bad in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([i not in left for i, bad in held if bad]) > 0.9
    assert np.mean([i in left for i, bad in held if not bad]) > 0.97
