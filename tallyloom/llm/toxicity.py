"""Toxicity by compression distance.

Two zstandard dictionaries hold windows of text: one of toxic documents, one of ordinary ones. A window is one word
with its blanks, lower-cased and widened to UTF-16, which halves the rounding of lengths to bytes; words over WINDOW
characters are cut into several windows. A window's gain is its compressed length under the ordinary dictionary less
that under the toxic one. A dictionary is raw text: of all windows that at least two of its documents hold, the ones
most documents hold, up to its size, commonest last, where offsets are short.

Most of a toxic document is ordinary prose, so a dictionary of all its windows tells little. Training therefore goes
in rounds over three folds of the training documents: dictionaries of two folds measure the windows of the third, and
of toxic documents only windows stay that gain more than all but a share of the ordinary ones; ordinary windows that
gain as much weigh HARD documents more for each that holds them, as counterexamples. No fold is measured by
dictionaries that hold its own text. The last dictionaries come from two folds. On the third the thresholds at which
windows count are set to quantiles of ordinary windows' gains, a logistic curve joins the counts and highest gains of
a document, and it is moved so that a share FALSE of the ordinary documents scores CUT or more.

Equal windows have equal lengths, so each task compresses a distinct window once.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents of each label are learned from, drawn by hash of their ids; whole texts.
DOCS = 2000
#: Windows: longest in characters. Dictionaries: bytes, level.
WINDOW, DICTIONARY, LEVEL = 48, 32_768, 12
#: Folds; shares of ordinary windows over which toxic ones must lie, by round; weight of ordinary counterexamples.
FOLDS, SHARES, HARD = 3, (0.05, 0.02, 0.01), 2
#: Quantiles of ordinary windows' gains at which windows count; ordinary documents at CUT or more.
STEPS, FALSE, CUT = (0.99, 0.997, 0.999, 0.9997), 0.005, 0.7
#: Distinct windows kept in a task's memory.
CACHED = 500_000


def windows(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if any(len(w) > WINDOW for w in words):
        return [w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]
    return words


def _bytes(window: str) -> bytes:
    return f" {window} ".encode("utf-16-le", "surrogatepass")


def _dictionary(counts: Counter[str]) -> bytes:
    """The windows of most documents, commonest last; those of one document alone only if there are no others."""
    out, size = [], 0
    for w in sorted([w for w, n in counts.items() if n > 1] or counts, key=lambda w: (-counts[w], w)):
        raw = _bytes(w)
        size += len(raw)
        if size > DICTIONARY:
            break
        out.append(raw)
    return b"".join(reversed(out)) or b"\0" * 8


class Gains(dict):
    """Window to gain, in bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.by = []
        for raw in (toxic, ordinary):
            d = zs.ZstdCompressionDict(raw)
            p = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=2 * WINDOW, dict_size=len(raw), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            self.by.append(zs.ZstdCompressor(dict_data=d, compression_params=p))

    def __missing__(self, window: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        b = _bytes(window)
        gain = self[window] = len(self.by[1].compress(b)) - len(self.by[0].compress(b))
        return gain


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    share: float
    weights: list[float] | None = None  # None: one label only was seen
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    steps: list[float] = field(default_factory=list)

    def gains(self) -> Gains:
        return Gains(self.toxic, self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.share)
        x = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def features(text: str | None, gains: Gains, steps: list[float]) -> list[float]:
    """What the score is made of; a text without windows counts as one window without gain."""
    x = np.array([gains[w] for w in windows(text)] or [0], float)
    top = np.sort(np.partition(x, -min(3, len(x)))[-3:])
    above = [float((x >= s).sum()) for s in steps]
    return [top[-1], top.mean(), *np.log1p(above), *np.log(np.array(above) / len(x) + 1e-4), x.mean(), np.log1p(len(x))]


def _counted(texts: list[str]) -> Counter[str]:
    """Windows and how many of the texts hold them."""
    out: Counter[str] = Counter()
    for t in texts:
        out.update(set(windows(t)))
    return out


def _quantile(gains: Gains, counts: Counter[str], share: float | tuple[float, ...]) -> np.ndarray:
    return np.quantile(np.repeat([gains[w] for w in counts], list(counts.values())) if counts else [0], share)


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, the classes weighted to their true share."""
    weight = np.where(y == 1, share * len(y) / y.sum(), (1 - share) * len(y) / (1 - y).sum())
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), a.T @ (weight * (p - y)) + 0.5 * w)
    return w


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model from training texts; share is that of toxic ones among all labelled. Equal texts count once.

    With fewer than FOLDS texts of a label the folds are the same.
    """
    if not toxic or not ordinary:
        return Model(b"\0" * 8, b"\0" * 8, float(bool(toxic)) if toxic or ordinary else 0.0)
    texts = [list(dict.fromkeys(t)) for t in (toxic, ordinary)]
    folds = [[t[k::FOLDS] or t for k in range(FOLDS)] for t in texts]
    every = kept = [[_counted(fold) for fold in side] for side in folds]

    def trained(of: list[int]) -> tuple[bytes, bytes]:
        return tuple(_dictionary(sum((side[k] for k in of), Counter())) for side in kept)

    for share_over in SHARES:
        new: list[list[Counter[str]]] = [[], []]
        for k in range(FOLDS):
            gains = Gains(*trained([j for j in range(FOLDS) if j != k]))
            limit = _quantile(gains, every[1][k], 1 - share_over)
            new[0].append(Counter({w: n for w, n in kept[0][k].items() if gains[w] > limit}))
            new[1].append(kept[1][k] + Counter({w: n * HARD for w, n in kept[1][k].items() if gains[w] >= limit}))
        if not any(new[0]):
            break  # nothing stands out any more
        kept = new
    model = Model(*trained(list(range(FOLDS - 1))), share)
    gains = model.gains()
    model.steps = sorted({float(s) for s in _quantile(gains, every[1][-1], STEPS)})
    aside = [*folds[0][-1], *folds[1][-1]]
    x = np.array([features(t, gains, model.steps) for t in aside])
    y = np.r_[np.ones(len(folds[0][-1])), np.zeros(len(folds[1][-1]))]
    model.centre, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    x = (x - model.centre) / model.scale
    w = _curve(x, y, share)
    z = x @ w[:-1] + w[-1]
    # Documents reach CUT where ordinary ones become rare, but never below the odds of a document nothing is known of;
    # below the curve's own place only if there are ordinary documents enough to show it.
    own, prior = np.log(CUT / (1 - CUT)), np.log(share / (1 - share)) if 0 < share < 1 else 0.0
    rare = np.quantile(z[y == 0], 1 - FALSE) + 1e-6
    w[-1] += own - max(rare, prior if (y == 0).sum() * FALSE >= 1 else own)
    model.weights = w.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, docs_most: int = DOCS) -> Model:
    """Fits on a bounded sample of labelled documents, docs_most of each label, drawn by hash of the id.

    labels has doc_id and toxic; only its rows are learned from. An id with both labels counts as toxic, and of several
    texts of one id the one that sorts first is learned from.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_most) for label in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # 2 x docs_most rows at most
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    total = counts.get(0, 0) + counts.get(1, 0)
    return fit([r["text"] or "" for r in rows if r["toxic"] == 1], [r["text"] or "" for r in rows if r["toxic"] == 0], counts.get(1, 0) / total if total else 0.0)


_gains: dict[bytes, tuple[Model, Gains]] = {}


def _held(packed: bytes) -> tuple[Model, Gains]:
    """The model and its windows seen so far, once for each Python worker."""
    if packed not in _gains:
        _gains.clear()
        model = pickle.loads(packed)  # noqa: S301  our own bytes
        _gains[packed] = (model, model.gains())
    return _gains[packed]


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; null and empty texts get that of a text without words."""
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, gains = _held(packed)
        for texts in batches:
            yield pd.Series(held.score(np.array([features(t, gains, held.steps) for t in texts]))) if len(texts) else pd.Series([], dtype="float64")

    return docs.withColumn(name, of(F.col(text_col)))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    An empty docs table gives no rows; without labels of both kinds every score is the share of toxic labels.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
