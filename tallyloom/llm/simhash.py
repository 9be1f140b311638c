"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints have 64 bits, one for each bit position of the XXH64 of a text's word shingles. The pivots are PIVOTS
reference fingerprints, spread out at random; a fingerprint's row of the pivot table holds its Hamming distance to
each. By the triangle inequality two fingerprints within RADIUS differ by at most RADIUS in every coordinate.

Two fingerprints within RADIUS = 2 agree in two of their BLOCKS = 4 blocks of bits, and meet in the cell of those two.
Pairs of a cell are discarded by their largest coordinate difference over the pivot table, and what survives is
verified bit by bit. (The coordinates alone cannot bring pairs together: two unrelated fingerprints lie within RADIUS
in a third of all coordinates, so a window over them would hold a fixed share of all pairs.)

Cells of more than CELL fingerprints are hot and are split by pivots of their own: the table is extended by every
fingerprint within one bit of a member, and only distances 0 and 1 to those are kept. Two members with a common such
pivot are within 1 + 1 = RADIUS by the triangle inequality, and every linked pair has one; members hang on the
smallest fingerprint at their pivot. Both ways are exact, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
import zstandard as zs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyloom.llm.common import cut, drop
from tallyloom.llm.components import components

BITS, BLOCKS, RADIUS, CELL, SHINGLE, SEED = 64, 4, 2, 48, 3, 42
#: Reference fingerprints: hashes of 0 to 127, as signed longs; coordinates that are looked at before all others.
PIVOTS, AHEAD = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) - 2**63 for i in range(128)], 8
#: What a fingerprint differs in from those within one bit of it.
WITHIN_ONE = [0, *[(1 << b) - ((1 << 64) if b == 63 else 0) for b in range(BITS)]]


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words; fewer words are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only, as the words are defined
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; of no words zero."""
    h = _shingles(text, shingle)
    n = len(h)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; null texts have no words."""

    @F.pandas_udf(LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("fp"))


def _coordinates(fp: Column) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in PIVOTS])


def candidates(cells: DataFrame) -> DataFrame:
    """Pairs (u, v, du, dv) of the fingerprints fp that share a cell, u below v, with their rows of the pivot table."""
    few = cells.select("fp", "cell", _coordinates(F.col("fp")).alias("d"))
    a, b = few.select(F.col("fp").alias("u"), "cell", F.col("d").alias("du")), few.select(F.col("fp").alias("v"), "cell", F.col("d").alias("dv"))
    return a.join(b, "cell").where("u < v").drop("cell")


def near_pivots(pairs: DataFrame) -> DataFrame:
    """The pairs that differ by RADIUS or less in every coordinate; a few coordinates discard nearly all others."""
    for k in range(AHEAD):
        pairs = pairs.where(F.abs(F.col("du")[k] - F.col("dv")[k]) <= RADIUS)
    return pairs.where(F.array_max(F.zip_with("du", "dv", lambda x, y: F.abs(x - y))) <= RADIUS)


def cells_of(fps: DataFrame) -> DataFrame:
    """(fp, cell, n): each distinct fingerprint in the cells, of n fingerprints, that hold another one too."""
    width, tables = BITS // BLOCKS, []
    for a, b in combinations(range(BLOCKS), 2):
        mask = (((1 << width) - 1) << (a * width)) | (((1 << width) - 1) << (b * width))
        agreed = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        tables.append(F.xxhash64(F.lit(len(tables)), agreed))
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*tables)).alias("cell"))
    return keyed.join(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cell").select("fp", "cell", "n")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) among the distinct longs in fps.fp, connecting all that differ in RADIUS bits or fewer.

    Pairs from small cells are edges themselves; hot cells give edges to the smallest fingerprint at each pivot.
    """
    met = cut(cells_of(fps), "cells")
    pairs = near_pivots(candidates(met.where(F.col("n") <= CELL))).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")

    many = met.where(F.col("n") > CELL).select("fp").distinct()
    near = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(p)) for p in WITHIN_ONE])).alias("at"))
    smallest = near.groupBy("at").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("at", "v")
    stars = near.join(smallest, "at").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    component_id is the smallest id reachable over links, the row's own included. Null texts and texts without words
    have fingerprint zero and link like any other; null ids never are the smallest unless there is no other, and an
    empty table gives no rows.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = cut(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "groups")
    labels = components(links(groups))
    labelled = cut(groups.join(labels, groups["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labels")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of = cut(labelled.join(smallest, "label").select("fp", "component_id"), "components")
    return fps.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicates by similarity: words of 64 bits in the wide fingerprint, samples and shingles in each.
WIDE, SAMPLES, DRAWN = 4, 16, 4
#: Shingles from which on a text's wide fingerprint tells of its similarity; texts a task keeps open while it verifies.
TELLS, OPEN = 64, 64
#: Members of a group that are compared pair by pair at the first level, and how that grows from level to level.
FEW, MORE = 32, 16
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of shingle hashes."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def wide(h: np.ndarray) -> tuple[list[int], list[int]]:
    """A fingerprint of WIDE longs of a text's distinct shingles, and SAMPLES fingerprints of DRAWN shingles each,
    those with the smallest hashes under one more hash: texts that share most shingles share some sample exactly."""
    if not len(h):
        return [0] * WIDE, [0] * SAMPLES
    words = []
    for k in range(WIDE):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            counts += np.unpackbits(_mixed(h[at : at + 65536], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        words.append(int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0]))
    samples = []
    for t in range(SAMPLES):
        x = _mixed(h, WIDE + t)
        few = np.sort(np.partition(x, DRAWN - 1)[:DRAWN] if len(x) > DRAWN else x)
        samples.append(xxhash.xxh64_intdigest(few.tobytes(), t) - 2**63)
    return words, samples


def most_bits(similarity: float) -> int:
    """Bits in which wide fingerprints of texts of that Jaccard similarity may differ: four deviations over the mean,
    so that about one such pair in 30,000 is lost. It lets dissimilar pairs by, and alone decides nothing."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * WIDE
    return int(n * p + 4 * np.sqrt(n * p * (1 - p)))


class Shingled(dict):
    """Distinct sorted shingles of the texts that a task has seen last, by node."""

    def __init__(self, shingle: int):
        super().__init__()
        self.shingle, self.press = shingle, zs.ZstdDecompressor()

    def of(self, node: int, body: bytes) -> np.ndarray:
        if node not in self:
            if len(self) >= OPEN:
                self.pop(next(iter(self)))
            self[node] = np.unique(_shingles(self.press.decompress(body).decode(), self.shingle))
        return self[node]


def _with_bodies(pairs: DataFrame, bodies: DataFrame, u: str, v: str) -> DataFrame:
    first = pairs.join(bodies.select(F.col("node").alias(v), F.col("body").alias("body_v")), v)
    return first.join(bodies.select(F.col("node").alias(u), F.col("body").alias("body_u")), u)


def _verified(pairs: DataFrame, bodies: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts' sets of shingles have that Jaccard similarity at least, counted exactly."""

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen = Shingled(shingle)
        for columns in batches:
            out = []
            for u, v, body_u, body_v in zip(*columns, strict=True):
                a, b = seen.of(u, body_u), seen.of(v, body_v)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both >= similarity * (len(a) + len(b) - both))
            yield pd.Series(out, dtype=bool)

    return _with_bodies(pairs, bodies, "u", "v").where(alike("u", "v", "body_u", "body_v")).select("u", "v")


def _rest(members: DataFrame, bodies: DataFrame, shingle: int) -> DataFrame:
    """members (hub, node, ...) with n, the node's number of shingles, same, how many of them its hub has, and rest,
    the others."""

    @F.pandas_udf("n int, same int, rest array<long>")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        seen = Shingled(shingle)
        for columns in batches:
            out = []
            for node, hub, body_u, body_v in zip(*columns, strict=True):
                a = seen.of(node, body_u)
                others = np.setdiff1d(a, seen.of(hub, body_v), assume_unique=True)
                out.append((len(a), len(a) - len(others), others.view("<i8")))
            yield pd.DataFrame(out, columns=["n", "same", "rest"])

    at = _with_bodies(members, bodies, "node", "hub").withColumn("m", measured("node", "hub", "body_u", "body_v"))
    return at.select(*members.columns, "m.*")


def _telling(rest: DataFrame, similarity: float) -> DataFrame:
    """(hub, token, size, node, label, n, small, same, left): the rarest shingles of each node's rest, of which two
    similar texts share one.

    Two texts u and v with s, the similarity, share s / (1 + s) (n_u + n_v) shingles at least, so the smaller of them
    has 2 s / (1 + s) n in common and the larger s n. At most same of these are in the hub, and the others are in both
    rests. Of a set of r shingles that shares c with another one the first r - c + 1, in any order that is the same for
    both, hold a common one; the rarest go first, and those that no other member has are not listed. small says
    whether a shingle is among them for the node as the smaller text; left counts the shingles of the rest from this
    one on, which are all that a text can share of it whose first common shingle this is. Only where c may be 0 this
    says nothing; _contained() finds those pairs.
    """
    tokens = rest.select("hub", "node", F.explode("rest").alias("token"))
    shared = tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = tokens.join(shared, ["hub", "token"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("size", "token"))).alias("listed"))
    own = rest.select("hub", "node", "label", "n", "same", F.size("rest").alias("r")).join(listed, ["hub", "node"])
    alone = F.col("r") - F.size("listed")

    def most(share: float) -> Column:
        c = F.greatest(F.lit(1), F.ceil(share * F.col("n") - 1e-9).cast("int") - F.col("same"))
        return F.greatest(F.lit(0), F.col("r") - c + 1 - alone)

    cut_off = own.withColumn("_small", most(2 * similarity / (1 + similarity))).withColumn("_large", most(similarity)).withColumn("_left", F.size("listed"))
    first = F.slice("listed", F.lit(1), F.col("_large"))
    some = cut_off.select("hub", "node", "label", "n", "same", "_left", "_small", F.posexplode(first).alias("_at", "x"))
    small, left = (F.col("_at") < F.col("_small")).alias("small"), (F.col("_left") - F.col("_at")).alias("left")
    return some.select("hub", F.col("x.token").alias("token"), F.col("x.size").alias("size"), "node", "label", "n", small, "same", left)


def _reaching(telling: DataFrame, similarity: float) -> DataFrame:
    """The rows of telling whose node can be similar to some text of its group (hub, token), by the group's smallest.

    A partner has no fewer shingles than the smallest of the group and than the similarity allows, and what both share
    is at most same + left of either. What this leaves out are texts whose own shingles fill most of what may differ.
    """
    smallest = telling.groupBy("hub", "token").agg(F.min("n").alias("_smallest"))
    needed = similarity / (1 + similarity) * (F.col("n") + F.greatest("_smallest", similarity * F.col("n"))) - 1e-9
    return telling.join(smallest, ["hub", "token"]).where(F.col("same") + F.col("left") >= needed).drop("_smallest")


def _contained(rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of one hub, not yet linked, that may be similar by shingles of the hub alone."""
    a = rest.where(F.col("same") >= similarity * F.col("n")).select("hub", F.col("node").alias("u"), F.col("label").alias("label_u"), F.col("n").alias("n_u"), F.col("same").alias("same_u"), F.col("apart").alias("apart_u"))
    b = a.select("hub", *[F.col(f"{c}u").alias(f"{c}v") for c in ("", "label_", "n_", "same_", "apart_")])
    needed = similarity / (1 + similarity) * (F.col("n_u") + F.col("n_v")) - 1e-9
    met = (F.col("label_u") != F.col("label_v")) & (F.col("apart_u") & (~F.col("apart_v") | (F.col("u") < F.col("v")))) & (F.least("same_u", "same_v") >= needed)
    return a.join(b, "hub").where(met).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _within(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) that share one of their telling shingles, may be similar if it is their first, and are not linked."""
    a, b = (met.select("hub", "token", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "n", "small", "same", "left")]) for x in "uv")
    ahead = (F.col("n_u") < F.col("n_v")) | (F.col("n_u") == F.col("n_v")) & (F.col("u") < F.col("v"))
    needed = similarity / (1 + similarity) * (F.col("n_u") + F.col("n_v")) - 1e-9
    enough = (F.least("same_u", "same_v") + F.least("left_u", "left_v") >= needed) & (F.col("n_u") >= similarity * F.col("n_v") - 1e-9)
    met = a.where("small_u").join(b, ["hub", "token"]).where(ahead & enough & (F.col("label_u") != F.col("label_v")))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hubs(met: DataFrame, on: list[str]) -> DataFrame:
    """(hub, node) of the groups of on that nodes meet in: a group's hub is the node that meets the most."""
    common = met.groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    middle = met.join(common, "node").groupBy(*on).agg(F.max(F.struct("common", "node"))["node"].alias("_to"))
    return met.join(middle, on).where("node <> _to").select(F.col("_to").alias("hub"), "node").distinct()


def similar(rows: DataFrame, key: str, shingle: int, similarity: float, text_col: str = "text") -> DataFrame:
    """(key, node, label): rows linked by near-duplicates share the label, equal fingerprints the node.

    Texts that share a sample's fingerprint are a group, and in the end any two of a group are linked, compared or
    proven apart. All are compared with the group's hub, which in a family of copies is what they were copied from.
    The hub serves as a pivot: two texts share no more of its shingles than either has, so where that is too little
    they must also share shingles that the hub lacks, and one of the rarest of these. Members that are not linked to
    their hub therefore meet the others again by such shingles, as long as what either has from the first common one on
    can be enough. Groups of at most FEW are compared pair by pair; larger ones get hubs of their own, and from one
    level to the next that bound grows MORE-fold, until no group has members of different labels. So a family of copies
    costs a pair for each copy and a passage that many documents share one for each of them; only where many texts lie
    a little below the similarity to each other by differences that they share are most pairs compared. Pairs are
    discarded by their numbers of shingles and, unless they have few, by distances to pivots and the differing bits of
    their wide fingerprints; the shingles of all that are left are compared. Texts travel compressed.
    """

    @F.pandas_udf("node long, n int, words array<long>, samples array<long>, body binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        press = zs.ZstdCompressor(level=3)
        for texts in batches:
            out = []
            for t in texts:
                h = np.unique(_shingles(t, shingle))
                out.append((xxhash.xxh64_intdigest(h.tobytes(), SEED) - 2**63, len(h), *wide(h), press.compress((t or "").encode())))
            yield pd.DataFrame(out, columns=["node", "n", "words", "samples", "body"])

    signed = cut(rows.select(key, of(F.col(text_col)).alias("s")).select(key, "s.*"), "signed")
    nodes = signed.groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.first("samples").alias("samples"))
    drawn = nodes.select("node", F.posexplode("samples").alias("sample", "value"))
    shared = drawn.groupBy("sample", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = cut(drawn.join(shared, ["sample", "value"]).select("sample", "value", "node"), "met")
    some = cut(met.select("node").distinct(), "some")
    words = cut(nodes.join(some, "node", "left_semi").select("node", "n", "words"), "words")
    bodies = cut(signed.join(some, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body")), "bodies")
    members = cut(_hubs(met, ["sample", "value"]), "members")
    labels = cut(met.sparkSession.createDataFrame([], "_node long, label long"), "labels")
    used, few = [met, some], FEW

    def linked(pairs: DataFrame) -> DataFrame:
        """labels with the links among pairs."""
        near = cut(_near(pairs, words, similarity), "near")
        found = cut(_verified(near, bodies, shingle, similarity), "found")
        known = found.unionByName(labels.select(F.col("_node").alias("u"), F.col("label").alias("v")))
        out = labels if found.isEmpty() else cut(components(known).withColumnRenamed("node", "_node"), "labels")
        used.extend([near, found, *([] if out is labels else [labels])])
        return out

    while True:
        sides = _labelled(_labelled(members, labels, "hub"), labels, "node")
        labels = linked(sides.where("label_hub <> label_node").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct())
        sides = _labelled(_labelled(members, labels, "hub"), labels, "node").select("hub", "node", F.col("label_node").alias("label"), (F.col("label_hub") != F.col("label_node")).alias("apart"))
        sides = cut(sides, "sides")
        open_ = sides.where("apart").groupBy("hub").agg(F.count(F.lit(1)).alias("_n"))
        rest = cut(_rest(sides.join(open_, "hub", "left_semi"), bodies, shingle), "rest")
        used.extend([members, sides])
        every = cut(_telling(rest, similarity), "every")
        telling = cut(_reaching(every, similarity), "telling")
        drop(every)
        groups = telling.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("_many"), F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least <> _most").select("hub", "token", "_many")
        met = cut(telling.join(groups, ["hub", "token"]), "met")
        pairs = cut(_contained(rest, similarity).unionByName(_within(met.where(F.col("_many") <= few), similarity)).distinct(), "pairs")
        labels = linked(pairs)
        used.extend([rest, telling, pairs, met])
        large = met.where(F.col("_many") > few).select(F.col("hub").alias("group"), "token", "node")
        if large.isEmpty():
            break
        members = cut(_hubs(large, ["group", "token"]), "members")
        few *= MORE
        for table in used:
            drop(table)
        used = []
    return signed.select(key, "node").join(labels, F.col("node") == F.col("_node"), "left").select(key, "node", F.coalesce("label", "node").alias("label"))


def _labelled(members: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """members with label_<column>, a node without links being its own label."""
    of = labels.select(F.col("_node"), F.col("label").alias("_label"))
    return members.join(of, F.col(column) == F.col("_node"), "left").withColumn(f"label_{column}", F.coalesce("_label", column)).drop("_node", "_label")


def _near(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that numbers of shingles, distances to the pivots and differing bits do not tell apart."""
    sides = [words.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("words").alias(f"words_{x}")) for x in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v").where(F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v"))
    limit = most_bits(similarity)
    apart = F.array_max(F.zip_with(_distances(F.col("words_u")), _distances(F.col("words_v")), lambda a, b: F.abs(a - b)))
    differ = F.aggregate(F.zip_with("words_u", "words_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return both.where((F.least("n_u", "n_v") < TELLS) | (apart <= limit) & (differ <= limit)).select("u", "v")


#: Reference fingerprints for the wide table: each word of a pivot repeats one of these patterns.
WIDE_PIVOTS = [0, 0x00000000FFFFFFFF, 0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555]


def _distances(words: Column) -> Column:
    """Hamming distances of a wide fingerprint to each pivot."""

    def to(pivot: int) -> Column:
        return F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x.bitwiseXOR(F.lit(pivot))))

    return F.array(*[to(p) for p in WIDE_PIVOTS])


def kept(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group of linked rows one stays, that with the smallest doc_id.

    Of rows that share an id, and of rows without one, the smaller text hash comes first; rows without an id come
    after all others. Rows that are the same in id and text count as one. Null texts have no shingles and are alike.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    keyed = docs.select("text", key.alias("key"))
    stay = cut(similar(keyed, "key", shingle, similarity).groupBy("label").agg(F.min("key").alias("key")).select("key"), "stay")
    # Repeats of a row go ahead of the shuffle, task by task, so none gathers; what is left is one row for each key.
    one = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").join(stay, "key", "left_semi").select("row.*")
