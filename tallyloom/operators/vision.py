"""Geometry of detected pages and measures on pixels, as column expressions; pictures in numpy by Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(corners: Column) -> Column:
    """Corners from the top left clockwise, by their sums and differences."""
    by = lambda key: F.transform(F.array_sort(F.transform(corners, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    s, d = by(lambda p: p["x"] + p["y"]), by(lambda p: p["y"] - p["x"])
    return F.array(s[0], d[0], s[3], d[3])


def area(quad: Column) -> Column:
    """Half the sum of cross products, without sign."""
    following = F.concat(F.slice(quad, 2, 3), F.slice(quad, 1, 1))
    return F.abs(F.aggregate(F.zip_with(quad, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def sides(quad: Column) -> Column:
    following = F.concat(F.slice(quad, 2, 3), F.slice(quad, 1, 1))
    return F.zip_with(quad, following, lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))


def sane_aspect(quad: Column) -> Column:
    """No side under a tenth of the longest."""
    s = sides(quad)
    return (F.array_max(s) > 0) & (F.array_min(s) / F.array_max(s) > 0.1)


def expanded(quad: Column, margin: float) -> Column:
    mean = lambda c: F.aggregate(F.transform(quad, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / 4
    return F.transform(quad, lambda p: F.struct((mean("x") + (p["x"] - mean("x")) * (1 + margin)).alias("x"), (mean("y") + (p["y"] - mean("y")) * (1 + margin)).alias("y")))


def contains(quad: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside: it crosses an odd number of sides to its right."""
    following = F.concat(F.slice(quad, 2, 3), F.slice(quad, 1, 1))
    crossed = F.zip_with(quad, following, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])).otherwise(False).cast("int"))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def confidence(coverage: Column, fill: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.lit(1.0), coverage / 0.55) * 0.55 + fill * 0.45))


def use_crop(found: Column, least: float = 0.45) -> Column:
    """crop, or whole if the outline is too uncertain."""
    return F.when(found >= least, "crop").otherwise("whole")


def ink_ratio(pixels: DataFrame, frame: str = "frame_id", value: str = "value", least: int = 64) -> DataFrame:
    """Share of pixels darker than 0.72 of the paper, which is the 90th percentile; null for under 64 pixels.

    The percentile is the value at position floor(0.9 x (n - 1)), by an aggregate over each frame.
    """
    paper = pixels.groupBy(frame).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("paper"))
    dark = pixels.join(paper, frame).groupBy(frame).agg(F.first("n").alias("n"), F.sum((F.col(value) < 0.72 * F.col("paper")).cast("int")).alias("dark"))
    return dark.select(frame, F.when(F.col("n") >= least, F.col("dark") / F.col("n")).alias("ink"))


def steady(frames: DataFrame, session: str = "session", order: str = "at", within: float = 0.025, needed: int = 3) -> DataFrame:
    """frames with fire: the reading that makes so many in a row within 2.5 % of the frame's diagonal.

    frames has is_receipt, an array of corners and the frame's width and height. A run starts anew at a frame that is
    no receipt or has moved; rows are numbered in runs by a running count of starts.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy(order)
    far = F.array_max(F.zip_with("corners", F.col("_before"), lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))))
    diagonal = F.sqrt(F.pow("width", 2) + F.pow("height", 2))
    moved = F.coalesce(far > within * diagonal, F.lit(True)) | ~F.coalesce(F.lag("is_receipt").over(w), F.lit(False))
    df = frames.withColumn("_before", F.lag("corners").over(w)).withColumn("_start", (moved | ~F.col("is_receipt")).cast("int")).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy(session, "_run").orderBy(order))
    return df.withColumn("run", F.when(F.col("is_receipt"), run).otherwise(0)).withColumn("fire", F.col("run") == needed).drop("_before", "_start", "_run")


def _flatten(image: np.ndarray) -> np.ndarray:
    """Divides by the background, a coarse local maximum, and stretches the 2nd to 98th percentile."""
    h, w = image.shape
    k = max(1, min(h, w) // 16)
    hh, ww = -(-h // k) * k, -(-w // k) * k
    tiles = np.pad(image, ((0, hh - h), (0, ww - w)), mode="edge").reshape(hh // k, k, ww // k, k).max(axis=(1, 3))
    y, x = np.arange(tiles.shape[0]) * k + k / 2, np.arange(tiles.shape[1]) * k + k / 2
    across = np.array([np.interp(np.arange(w), x, row) for row in tiles])
    background = np.array([np.interp(np.arange(h), y, column) for column in across.T]).T
    flat = np.clip(image / np.maximum(background, 1) * 255, 0, 255)
    low, high = np.percentile(flat, [2, 98])
    return np.clip((flat - low) / max(high - low, 1) * 255, 0, 255).astype(np.uint8)


def flatten(images: DataFrame) -> DataFrame:
    """images (id, width, height, pixels: bytes of grey values) with their uneven light taken out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [_flatten(np.frombuffer(p, np.uint8).reshape(h, w).astype(float)).tobytes() for p, w, h in zip(df["pixels"], df["width"], df["height"], strict=True)]
            yield df.assign(pixels=out)

    return images.select("id", "width", "height", "pixels").mapInPandas(run, "id long, width int, height int, pixels binary")
