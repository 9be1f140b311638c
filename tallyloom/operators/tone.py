"""Tone of pictures as rows of pixels (frame_id, x, y, value): contrast by tile, stretch, sharpening, black and white.

Everything is a join, an aggregate or an expression over arrays: histograms are arrays of 256 counts by frame and tile,
their prefix sums tables of new values, and a blur is a weighted sum along the arrays of rows and then of columns.
Values are whole numbers from 0 to 255; pixels without a value or place are left out, and a pixel that is given twice
counts twice in histograms and once, with its larger value, elsewhere. frames has (frame_id, width, height).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.base import let

LEVELS = 256
#: Tiles each way and the clip limit; blur and strength of sharpening; how far below its surroundings ink is.
TILES, CLIP, SIGMA, AMOUNT, DARKER = 8, 2.0, 1.4, 0.6, 10


def _rounded(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("int")


def _sound(pixels: DataFrame) -> DataFrame:
    return pixels.where("frame_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND value BETWEEN 0 AND 255").select("frame_id", "x", "y", F.col("value").cast("int").alias("value"))


def _once(pixels: DataFrame) -> DataFrame:
    return _sound(pixels).groupBy("frame_id", "x", "y").agg(F.max("value").alias("value"))


def histograms(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and counts, an array of the pixels of each value: counted by value first, so no array is shuffled."""
    counts = pixels.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    held = F.map_from_entries(F.collect_list(F.struct("value", "_n")))
    return counts.groupBy(*keys).agg(held.alias("_m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda v: F.coalesce(F.try_element_at("_m", v), F.lit(0).cast("long"))).alias("counts"))


def running(counts: Column) -> Column:
    """Prefix sums of an array."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
    return F.aggregate(counts, start, lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.array_append(s["all"], s["sum"] + n).alias("all")), lambda s: s["all"])


def clipped(counts: Column, limit: Column) -> Column:
    """Counts with what is over limit taken off and dealt out again: evenly, and what is left one each at even steps."""

    def dealt(over: Column) -> Column:
        each, left = F.floor(over / LEVELS), over % LEVELS
        step = F.greatest(F.floor(F.lit(LEVELS) / F.greatest(left, F.lit(1))), F.lit(1))
        return F.transform(counts, lambda n, i: F.least(n, limit) + each + F.when((i % step == 0) & (i / step < left), 1).otherwise(0))

    # what is over is found once and not for each of the counts
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + F.greatest(n - limit, F.lit(0))), dealt)


def equalized(pixels: DataFrame, frames: DataFrame, tiles: int = TILES, clip: float = CLIP) -> DataFrame:
    """Pixels with contrast raised where they are: each tile's histogram, clipped at clip times an even one, gives a
    table of new values, and a pixel takes those of the four nearest tiles by its distance to their middles.

    Tiles part width and height evenly. A table comes to a pixel by its own value only, so a pixel meets four rows.
    """
    rows = _once(pixels).join(frames.select("frame_id", "width", "height"), "frame_id")
    place = lambda p, size: F.least(F.floor(F.col(p) * tiles / F.col(size)), F.lit(tiles - 1)).cast("int")
    tiled = rows.withColumns({"tx": place("x", "width"), "ty": place("y", "height")})
    h = histograms(tiled, ("frame_id", "ty", "tx"))

    def table(counts: Column, total: Column) -> Column:
        limit = F.greatest(F.lit(1), F.floor(F.lit(clip) * total / LEVELS))
        return F.transform(running(clipped(counts, limit)), lambda s: _rounded(s * 255.0 / total))

    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    tables = h.select("frame_id", "ty", "tx", F.posexplode(let(total, lambda t: table(F.col("counts"), t))).alias("value", "_new"))

    def sides(p: str, size: str) -> Column:
        at = (F.col(p) + 0.5) * tiles / F.col(size) - 0.5
        low = F.floor(at)
        keep = lambda t: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), t)).cast("int")
        return F.array(F.struct(keep(low).alias("t"), (low + 1 - at).alias("w")), F.struct(keep(low + 1).alias("t"), (at - low).alias("w")))

    near = rows.select("frame_id", "x", "y", "value", F.explode(sides("x", "width")).alias("_a"), sides("y", "height").alias("_bs")).select("frame_id", "x", "y", "value", "_a", F.explode("_bs").alias("_b"))
    near = near.select("frame_id", "x", "y", "value", F.col("_a.t").alias("tx"), F.col("_b.t").alias("ty"), (F.col("_a.w") * F.col("_b.w")).alias("_w"))
    # a tile that the pixels leave empty has no table; the others' weights then stand for all
    met = near.join(tables, ["frame_id", "ty", "tx", "value"]).groupBy("frame_id", "x", "y").agg((F.sum(F.col("_w") * F.col("_new")) / F.sum("_w")).alias("_v"))
    return met.select("frame_id", "x", "y", _rounded(F.round("_v", 6)).alias("value"))


def stretched(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Pixels with the values between two shares of the histogram spread over all; what lies outside is cut off. The
    lower end is 1 at least."""
    rows = _sound(pixels)
    h = histograms(rows, ("frame_id",)).select("frame_id", running(F.col("counts")).alias("_run"))
    at = lambda share: F.array_position(F.transform("_run", lambda s: s >= F.element_at("_run", -1) * share), F.lit(True)) - 1
    ends = h.select("frame_id", F.greatest(F.lit(1), at(low)).alias("_low"), at(high).alias("_high"))
    spread = (F.col("value") - F.col("_low")) * 255.0 / F.greatest(F.lit(1), F.col("_high") - F.col("_low"))
    return rows.join(ends, "frame_id").select("frame_id", "x", "y", _rounded(spread).alias("value"))


def bell(sigma: float, size: int | None = None) -> list[float]:
    """Weights of a blur, an odd number of them that sum to 1."""
    r = (size // 2) if size else max(1, math.ceil(3 * sigma))
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _along(rows: DataFrame, line: str, at: str, weights: Sequence[float]) -> DataFrame:
    """Weighted sums along each line; beyond its ends the line goes on with its end values."""
    r = len(weights) // 2
    arrays = rows.groupBy("frame_id", line).agg(F.array_sort(F.collect_list(F.struct(at, "_v"))).alias("_l"))
    w = F.array(*[F.lit(x) for x in weights])
    n = F.size("_l")

    def total(_: Column, i: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda k: F.get(w, k + r) * F.get("_l", F.greatest(F.lit(0), F.least(n - 1, i + k)))["_v"])
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    return arrays.select("frame_id", line, F.explode(F.arrays_zip(F.transform("_l", lambda e: e[at]).alias(at), F.transform("_l", total).alias("_v"))).alias("_e")).select("frame_id", line, f"_e.{at}", "_e._v")


def blurred(pixels: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(frame_id, x, y, _v): values blurred along rows and then along columns; a gap in a line is passed over. A line of
    pixels is one array, so a task holds one line at a time."""
    rows = _once(pixels).withColumn("_v", F.col("value").cast("double")).drop("value")
    return _along(_along(rows, "y", "x", weights), "x", "y", weights)


def sharpened(pixels: DataFrame, sigma: float = SIGMA, amount: float = AMOUNT) -> DataFrame:
    """Pixels moved away from their blurred surroundings by amount."""
    both = _once(pixels).join(blurred(pixels, bell(sigma)), ["frame_id", "x", "y"])
    return both.select("frame_id", "x", "y", _rounded(F.round(F.col("value") * (1 + amount) - F.col("_v") * amount, 6)).alias("value"))


def block(width: int, height: int) -> int:
    """The size of the surroundings that ink is told by: a 45th of the longer side, odd, 15 at least."""
    n = max(15, int(max(width, height) / 45 + 0.5))
    return n + 1 - n % 2


def black_and_white(pixels: DataFrame, size: int, darker: float = DARKER) -> DataFrame:
    """255 for pixels brighter than their weighted surroundings of that size less darker, 0 for ink."""
    weights = bell(0.3 * ((size - 1) * 0.5 - 1) + 0.8, size)
    both = _once(pixels).join(blurred(pixels, weights), ["frame_id", "x", "y"])
    return both.select("frame_id", "x", "y", F.when(F.col("value") > F.round(F.col("_v"), 6) - darker, 255).otherwise(0).alias("value"))
