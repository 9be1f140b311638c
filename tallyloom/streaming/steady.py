"""Frames of a camera as a stream: a capture fires once an outline has been held still."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sources of outlines that are trusted, the least share of the frame, the bounds of ink.
TRUSTED, LEAST_COVERAGE, INK = ("paper", "contour"), 0.12, (0.03, 0.6)
#: How far a corner may move, as a share of the diagonal, and how many readings make a hold.
WITHIN, NEEDED = 0.025, 3

FRAME = "session string, at long, detection string, coverage double, ink double, corners array<double>, width double, height double"
OUT = "session string, at long, status string, steady int, capture boolean"
STATE = "steady int, corners array<double>"


def looks_like_receipt(detection: Column, coverage: Column, ink: Column, corners: Column) -> Column:
    test = corners.isNotNull() & detection.isin(*TRUSTED) & (coverage >= LEAST_COVERAGE) & ink.between(*INK)
    return F.coalesce(test, F.lit(False))


def _held(before: list[float], now: list[float], limit: float) -> bool:
    return len(before) == len(now) and all(math.hypot(before[i] - now[i], before[i + 1] - now[i + 1]) <= limit for i in range(0, len(now), 2))


def _advance(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    steady, corners = state.get if state.exists else (0, None)
    rows = pd.concat(list(frames)).sort_values("at")
    out = []
    for at, fit, found, width, height in zip(rows["at"], rows["fit"], rows["corners"], rows["width"], rows["height"], strict=True):
        if not fit:
            steady, corners = 0, None
        else:
            found = [float(x) for x in found]
            steady = steady + 1 if corners is not None and _held(corners, found, WITHIN * math.hypot(width, height)) else 1
            corners = found
        out.append((key[0], at, "holding" if steady >= 2 else "searching", steady, steady >= NEEDED))
    state.update((steady, list(corners) if corners is not None else None))
    yield pd.DataFrame(out, columns=["session", "at", "status", "steady", "capture"])


def watch(frames: DataFrame) -> DataFrame:
    """(session, at, status, steady, capture) of each frame of a stream (FRAME), by a fold over each session's frames.

    A frame that is no receipt drops the count to zero; one whose corners stay within WITHIN of the frame before adds
    to it. A session's state is a count and eight numbers. Frames of a batch are taken in the order of at.
    """
    fit = looks_like_receipt(F.col("detection"), F.col("coverage"), F.col("ink"), F.col("corners"))
    return frames.withColumn("fit", fit).groupBy("session").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
