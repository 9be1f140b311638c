"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network in numpy.

Tokens are runs of letters, digits or other signs. A token's index vector has a few signed ones at places its hash
gives; its word vector sums the index vectors of its neighbours in the training texts, shifted by one for those
before it. Tokens outside the vocabulary share the vector of their shape. A document is pooled to the mean and spread
of its vectors and the mean step from one to the next, so that monotony shows as well as vocabulary. The network's
logits are divided by a temperature fitted on training documents kept aside, against targets a little short of 0 and 1
so that it is finite where the labels are told apart without error, and moved to the labels' true odds.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents of each label are learned from, drawn by hash of their ids; whole texts.
DOCS = 2000
#: Vector size, ones in an index vector, vocabulary, neighbours on each side.
SIZE, ONES, VOCABULARY, NEAR = 64, 6, 20_000, 2
HIDDEN, EPOCHS, DECAY = 64, 40, 1e-4
#: Tokens pooled at once, which bounds memory for long texts.
BATCH = 50_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """The class that unknown tokens share: kind of sign, case and length to a power of two."""
    size = min(len(token), 64).bit_length()
    if token[0].isalpha():
        case = "up" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "low" if token.islower() else "mixed"
        return f"\0{case}{size}"
    return f"\0{'digit' if token[0].isdigit() else 'sign'}{size}"


def _index_vector(token: str) -> np.ndarray:
    v = np.zeros(SIZE, np.float32)
    h = xxhash.xxh128_digest(token.encode("utf-8", "surrogatepass"))
    for i in range(ONES):
        v[h[2 * i] % SIZE] += 1 if h[2 * i + 1] & 1 else -1
    return v


@dataclass
class Model:
    words: list[str]
    vectors: np.ndarray
    layers: list[np.ndarray] | None  # None: one label only was seen
    centre: np.ndarray
    scale: np.ndarray
    temperature: float
    shift: float
    share: float

    def vocabulary(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), self.share)
        z = _logits(self.layers, (pooled - self.centre) / self.scale) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Places(dict):
    """Token to its row of the vectors; forgets the tokens it looked up when they are too many."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, token: str) -> int:
        if len(self) > len(self.known) + 500_000:
            self.clear()
            self.update(self.known)
        at = self[token] = self.known.get(shape(token), self.known["\0"])
        return at


def pool(text: str | None, places: Places, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean step of a whole text's vectors; zeros for no tokens."""
    at = np.array([places[t] for t in TOKEN.findall(text or "")], np.int64)
    if not len(at):
        return np.zeros(3 * SIZE)
    total, square, step = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for i in range(0, len(at), BATCH):
        v = vectors[at[i : i + BATCH + 1]]
        step += np.abs(np.diff(v, axis=0)).sum(0)
        v = v[:BATCH]
        total += v.sum(0)
        square += (v * v).sum(0)
    n = len(at)
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(square / n - mean * mean, 0)), step / max(1, n - 1)])


def _logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    m = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    mean, square, step = [np.zeros_like(w) for w in m], [np.zeros_like(w) for w in m], 0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            h = np.tanh(x[i] @ m[0] + m[1])
            p = 1 / (1 + np.exp(-np.clip(h @ m[2] + m[3], -30, 30)))
            d = weight[i] * (p - y[i]) / len(i)
            back = d[:, None] * m[2] * (1 - h * h)
            step += 1
            for k, g in enumerate((x[i].T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True))):
                g = g + DECAY * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m[k] = m[k] - 0.002 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return m


def word_vectors(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The commonest tokens and every shape, with their random-indexing vectors, of unit length."""
    split = [TOKEN.findall(t) for t in texts]
    counts = Counter(t for ts in split for t in ts)
    words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1]
    shapes = sorted({"\0", *(shape(w) for w in counts)})
    words += shapes
    place = {w: i for i, w in enumerate(words)}
    index = np.array([_index_vector(w) for w in words]).reshape(len(words), SIZE)
    vectors = np.zeros((len(words), SIZE))
    for ts in split:
        if not ts:
            continue
        own = np.array([place.get(t, -1) for t in ts])
        form = np.array([place[shape(t)] for t in ts])
        at = np.where(own < 0, form, own)
        around = np.zeros((len(at), SIZE))
        for k in range(1, NEAR + 1):
            around[k:] += np.roll(index[at[:-k]], 1, axis=1)
            around[:-k] += index[at[k:]]
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        vectors[at[order][starts]] += np.add.reduceat(around[order], starts, axis=0)
        order = np.argsort(form, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(form[order]) > 0])
        vectors[form[order][starts]] += np.add.reduceat(around[order], starts, axis=0) * (own < 0).mean()
    vectors -= vectors.sum(0) / max(1, len(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return words, vectors.astype(np.float32)


def fit(good: list[str], poor: list[str], share: float) -> Model:
    """A model from training texts; share is that of good ones among all labelled."""
    if not good or not poor:
        return Model(["\0"], np.zeros((1, SIZE), np.float32), None, np.zeros(1), np.ones(1), 1.0, 0.0, float(bool(good)))
    words, vectors = word_vectors([*good, *poor])
    model = Model(words, vectors, None, np.zeros(1), np.ones(1), 1.0, 0.0, share)
    places = Places(model.vocabulary())
    x = np.array([pool(t, places, vectors) for t in [*good, *poor]])
    y = np.r_[np.ones(len(good)), np.zeros(len(poor))]
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - model.centre) / model.scale
    aside = np.arange(len(x)) % 5 == 0
    if 0 < y[aside].sum() < aside.sum() and 0 < y[~aside].sum() < (~aside).sum():
        z = _logits(_train(x[~aside], y[~aside]), x[aside])
        heats = np.exp(np.linspace(np.log(0.05), np.log(50), 200))
        # Each label's target: the share of its documents that one more of either label would leave it.
        sides = [(z[y[aside] == v] * (1 if v else -1), (y[aside] == v).sum()) for v in (0, 1)]
        loss = [sum(((n + 1) / (n + 2) * np.logaddexp(0, -m / t) + np.logaddexp(0, m / t) / (n + 2)).mean() for m, n in sides) for t in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
    model.layers = _train(x, y)
    model.shift = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    return model


def train(docs: DataFrame, labels: DataFrame, docs_most: int = DOCS) -> Model:
    """Fits on a bounded sample of labelled documents, docs_most of each label, drawn by hash of the id.

    labels has doc_id and quality; only its rows are learned from. An id with both labels counts as good, and of
    several texts of one id the one that sorts first is learned from.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_most) for label in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # 2 x docs_most rows at most
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    total = counts.get(0, 0) + counts.get(1, 0)
    return fit([r["text"] or "" for r in rows if r["quality"] == 1], [r["text"] or "" for r in rows if r["quality"] == 0], counts.get(1, 0) / total if total else 0.0)


_models: dict[bytes, tuple[Model, Places]] = {}


def _held(packed: bytes) -> tuple[Model, Places]:
    if packed not in _models:
        _models.clear()
        model = pickle.loads(packed)  # noqa: S301  our own bytes
        _models[packed] = (model, Places(model.vocabulary()))
    return _models[packed]


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; null texts are empty, and those have a score too."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # VOCABULARY bounds its size

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, places = _held(packed.value)
        for texts in batches:
            yield pd.Series(held.score(np.array([pool(t, places, held.vectors) for t in texts]))) if len(texts) else pd.Series([], dtype="float64")

    return docs.withColumn(name, of(F.col(text_col)))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    An empty docs table gives no rows; without labels of both kinds every score is the share of good labels.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
