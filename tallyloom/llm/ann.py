"""Nearest neighbours by learned partitions, in two levels.

On a bounded sample of vectors a neighbour graph is built and cut into balanced parts, and a small classifier learns
to tell a vector's part. Each part is cut again in the same way by a sample of its own rows, in Spark tasks, so that
parts x parts cells share the table; both numbers grow with the square root of its size and a cell stays at about
CELL_ROWS rows. Every row is indexed in the cell that the classifiers name. A query visits the most probable parts,
and in each the most probable cells, until their probabilities add up to a share that is calibrated to the wanted
recall on sample rows kept out of graph and training, and until they hold more than k rows. Rows of visited cells are
scored exactly.

Equal vectors are indexed and searched once: of their ids only the k + 1 smallest can be among anyone's k nearest.
Cells with many rows or queries are split into blocks and turns by their own counts, so a hot cell meets in many tasks
and others are not copied.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

K = 20
#: Rows a cell should hold; fewest parts of each level; graph degree. A level's sample is the larger of SAMPLE rows and
#: EACH rows a part; a tenth of it, at most PROBES rows, is kept out to calibrate on.
CELL_ROWS, LEAST_PARTS, DEGREE, SAMPLE, EACH, PROBES = 2048, 4, 16, 6000, 64, 400
#: Recall that each level's visited probability is calibrated to; rows of a routing group, rows and queries that meet.
WANTED, ROUTED, BLOCK, TURN = 0.985, 16_384, 16_384, 8192


@dataclass
class Router:
    """Tells parts from unit vectors by one hidden layer; mass is the probability to be visited."""

    first: np.ndarray
    first_b: np.ndarray
    second: np.ndarray
    second_b: np.ndarray
    mass: float = 1.0
    sizes: np.ndarray | None = field(default=None)  # rows in each part, where known

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(x @ self.first + self.first_b) @ self.second + self.second_b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def visits(self, x: np.ndarray, least: int = 0) -> np.ndarray:
        """Which parts each row of x visits: most probable first, until mass is reached and they hold least rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        wanted = np.cumsum(sorted_p, 1) - sorted_p < self.mass
        if self.sizes is not None:
            held = self.sizes[order]
            wanted |= np.cumsum(held, 1) - held < least
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, wanted, 1)
        return out


def blank(width: int, parts: int) -> Router:
    """A router that has learned nothing: all parts are equally likely, and all are visited."""
    return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Each row's nearest other rows by inner product, computed in blocks."""
    degree = max(0, min(degree, len(x) - 1))
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x) if degree else 0, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of nearly equal size with many neighbours inside: starts from cuts across the widest direction, then
    moves rows to the part most of their neighbours are in while there is room, best gains first. With fewer rows than
    parts some parts are empty."""
    label = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), parts)]
    while groups:
        g, n = groups.pop()
        if n == 1 or len(g) < 2:
            label[g] = sum(m for _, m in groups)
            continue
        c = x[g] - x[g].mean(0)
        v = np.linalg.svd(c[:2000], full_matrices=False)[2][0]
        order = g[np.argsort(c @ v, kind="stable")]
        at = len(g) * (n // 2) // n
        groups += [(order[:at], n // 2), (order[at:], n - n // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    rows = np.arange(len(x))
    for _ in range(rounds):
        counts = np.zeros((len(x), parts), np.int32)
        np.add.at(counts, (np.repeat(rows, graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(counts, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = counts.argmax(1)
        gain = counts[rows, best] - counts[rows, label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and size[label[i]] > room // 3:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved <= len(x) // 500:
            break
    return label


def _classifier(x: np.ndarray, y: np.ndarray, parts: int, hidden: int = 64, epochs: int = 25) -> Router:
    rng = np.random.default_rng(3)
    m = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)) * 2, np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    mean, square, step = [np.zeros_like(w) for w in m], [np.zeros_like(w) for w in m], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.tanh(x[i] @ m[0] + m[1])
            z = h @ m[2] + m[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            back = (p @ m[2].T) * (1 - h * h)
            step += 1
            for k, g in enumerate((x[i].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m[k] = m[k] - 0.004 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*m)


def fit(rows: np.ndarray, probes: np.ndarray, parts: int, k: int = K) -> Router:
    """Graph, balanced parts and classifier of rows; what a query visits is calibrated on probes, which are no rows."""
    if not len(rows):
        return blank(rows.shape[1], parts)
    x = _unit(rows)
    router = _classifier(x, balanced_parts(x, neighbour_graph(x, DEGREE), parts), parts)
    if not len(probes):
        return router
    # Parts as the index will have them, neighbours as the search will score them.
    own = router.probabilities(x).argmax(1)
    near = np.argsort(-(probes @ rows.T), axis=1, kind="stable")[:, :k]
    p = router.probabilities(_unit(probes))
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_p = np.take_along_axis(p, order, 1)
    before = np.zeros_like(p)  # probability of all parts more probable than each
    np.put_along_axis(before, order, np.cumsum(sorted_p, 1) - sorted_p, 1)
    needed = np.sort(np.take_along_axis(before, own[near], 1), axis=None)
    router.mass = float(np.nextafter(needed[int(np.ceil(WANTED * len(needed))) - 1], 2))
    return router


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(queries: np.ndarray, keys: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], k: int) -> pd.DataFrame:
    """The k best rows of a block for each query: a matrix product finds them with a margin, and a sum in fixed order
    scores them, so that equal vectors score equal wherever they lie. A vector may stand for several rows."""
    out_q, out_i, out_s = [], [], []
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ vectors.T
        for q, row in enumerate(s, at):
            floor = -np.inf if len(row) <= k else np.partition(row, -k)[-k]
            near = np.flatnonzero(row >= floor - 1e-9 * max(1.0, abs(floor) if np.isfinite(floor) else 1.0))
            exact = (vectors[near] * queries[q]).sum(1)
            found = np.concatenate([ids[j] for j in near])
            score = np.repeat(exact, [len(ids[j]) for j in near])
            order = np.lexsort((found, -score))[:k]
            out_q.append(np.full(len(order), keys[q]))
            out_i.append(found[order])
            out_s.append(score[order])
    return pd.DataFrame({"key": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})


def _salted(rows: DataFrame, counts: DataFrame, on: list[str], n: str, size: int, name: str) -> DataFrame:
    """rows with a salt that deals each group of on out to as many tasks as its number n asks for."""
    few = counts.select(*on, F.ceil(F.col(n) / size).cast("int").alias("_of"))
    return rows.join(few, on).withColumn(name, F.pmod(F.xxhash64("key", F.lit(name)), F.greatest(F.col("_of"), F.lit(1))).cast("int")).drop("_of")


def _copied(rows: DataFrame, counts: DataFrame, on: list[str], n: str, size: int, name: str) -> DataFrame:
    """rows once for each salt that _salted(counts, n, size) deals its group's other side out to."""
    few = counts.select(*on, F.greatest(F.ceil(F.col(n) / size).cast("int"), F.lit(1)).alias("_of"))
    return rows.join(few, on).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")


def probe_share(rows: float, parts: int, visits: float) -> float:
    """The share of so many sampled rows to keep out as probes, if each goes to so many of the parts: a tenth, but no
    more than give every part about 2 * PROBES of them, whatever the number of rows and parts is."""
    return min(0.1, 2 * PROBES * parts / max(1.0, visits) / max(1.0, rows))


def search(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which queries holds.

    Vectors that are null, zero, empty or hold null or non-finite components, and rows without id, take no part. A
    vector shorter than others ends in zeros. Fewer than k candidates give all of them; ties go to the smaller id.
    Repeated rows of one id count as one, the one whose vector sorts first. An empty table gives no rows, and further
    columns are not looked at.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("q")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = cut(good.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    first = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id", F.row_number().over(first).alias("_r")).where(F.col("_r") <= k + 1)  # limited ahead of the shuffle
    distinct = cut(few.groupBy("v").agg(F.min("id").alias("key"), F.array_sort(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "distinct")
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = cut(rows.where("q").select(F.col("id").alias("query_id"), "v").join(distinct.select("v", "key"), "v").select("query_id", "key"), "asking")
    parts = max(LEAST_PARTS, int(np.ceil(np.sqrt(n / CELL_ROWS))))
    drawn = max(SAMPLE, EACH * parts)

    # First level: its sample comes to the driver, EACH vectors a part or SAMPLE at most.
    sample = _matrix(distinct.orderBy("h", "key").limit(drawn).select("v").toPandas()["v"], width)
    aside = min(PROBES, len(sample) // 10)
    top = fit(sample[aside:], sample[:aside], parts, k)
    packed = pickle.dumps(top)

    @F.pandas_udf("int")
    def part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = pickle.loads(packed)  # noqa: S301  our own bytes
        for v in batches:
            yield pd.Series(r.probabilities(_unit(_matrix(v, width))).argmax(1).astype("int32") if len(v) else [], dtype="int32")

    placed = cut(distinct.select("key", "v", "ids", "h", part("v").alias("part")), "placed")
    by_part = cut(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("held")), "parts")
    top.sizes = np.zeros(parts, np.int64)
    for r in by_part.collect():  # one row a part
        top.sizes[r["part"]] = r["held"]
    sized = pickle.dumps(top)

    @F.pandas_udf("array<int>")
    def visited(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = pickle.loads(sized)  # noqa: S301  our own bytes
        for v in batches:
            yield pd.Series([np.flatnonzero(x).astype("int32") for x in r.visits(_unit(_matrix(v, width)), k + 1)] if len(v) else [], dtype=object)

    # Second level: each part is fitted in a task, on a sample of its rows and on probes that visit it.
    span = 1 << 30
    share = int(min(1.0, drawn * parts / n) * span)
    some = placed.where(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(span)) < share)
    visits = float(top.visits(_unit(sample[: max(1, aside)]), k + 1).sum(1).mean())
    kept_out = int(probe_share(min(n, drawn * parts), parts, visits) * span)
    probe = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(span)) < kept_out
    members = some.where(~probe).select("part", F.lit(0).alias("probe"), "h", "v")
    probes = some.where(probe).select("h", "v", F.explode(visited("v")).alias("part")).select("part", F.lit(1).alias("probe"), "h", "v")

    def learn(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["probe", "h"])
        x = _matrix(df["v"], width)
        of = df["probe"].to_numpy() == 1
        router = fit(x[~of], x[of][:PROBES], parts, k)
        return pd.DataFrame({"part": df["part"].iloc[:1], "router": [pickle.dumps(router)]})

    routers = cut(members.unionByName(probes).groupBy("part").applyInPandas(learn, "part int, router binary"), "routers")

    def held(df: pd.DataFrame) -> Router:
        return pickle.loads(df["router"].iloc[0]) if len(df) else blank(width, parts)  # noqa: S301  our own bytes

    def place(rows: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        cell = held(router).probabilities(_unit(_matrix(rows["v"], width))).argmax(1) if len(rows) else np.zeros(0)
        return rows[["part", "key", "v", "ids"]].assign(cell=cell.astype("int32"))

    salted = _salted(placed.select("part", "key", "v", "ids"), by_part, ["part"], "n", ROUTED, "salt")
    sent = _copied(routers, by_part, ["part"], "n", ROUTED, "salt")
    stored = cut(salted.groupBy("part", "salt").cogroup(sent.groupBy("part", "salt")).applyInPandas(place, "part int, key long, v array<double>, ids array<long>, cell int"), "stored")
    cells = cut(stored.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("held")), "cells")

    def choose(rows: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        out = rows[["part", "key", "v"]].assign(cell=[np.zeros(0, "int32")] * len(rows))
        if len(rows):
            r = held(router)
            r.sizes = np.zeros(parts, np.int64)
            for c in router["cells"].iloc[0] if len(router) else ():
                r.sizes[c["cell"]] = c["held"]
            visits = r.visits(_unit(_matrix(rows["v"], width)), k + 1) & (r.sizes > 0)
            out["cell"] = [np.flatnonzero(x).astype("int32") for x in visits]
        return out

    asked = distinct.join(asking.select("key").distinct(), "key", "left_semi").select("key", "v", F.explode(visited("v")).alias("part"))
    asked = cut(asked, "asked")
    by_asked = cut(asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "asked-parts")
    known = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "held")).alias("cells")).join(routers, "part", "left")
    known = known.withColumn("router", F.coalesce("router", F.lit(pickle.dumps(blank(width, parts)))))
    salted = _salted(asked, by_asked, ["part"], "n", ROUTED, "salt")
    sent = _copied(known, by_asked, ["part"], "n", ROUTED, "salt")
    routed = salted.groupBy("part", "salt").cogroup(sent.groupBy("part", "salt")).applyInPandas(choose, "part int, key long, v array<double>, cell array<int>")
    routed = cut(routed.withColumn("cell", F.explode("cell")), "routed")
    meeting = cells.join(routed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n_asked")), ["part", "cell"])
    meeting = cut(meeting, "meeting")

    on = ["part", "cell"]
    left = _copied(_salted(routed, meeting, on, "n_asked", TURN, "turn"), meeting, on, "n", BLOCK, "block")
    right = _copied(_salted(stored, meeting, on, "n", BLOCK, "block"), meeting, on, "n_asked", TURN, "turn")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return _best(_matrix(left["v"], width), left["key"].to_numpy(), _matrix(right["v"], width), list(right["ids"]), k + 1)

    on = ["part", "cell", "block", "turn"]
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, "key long, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("key", "vec_id", "score")
    own = found.join(asking, "key").where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
