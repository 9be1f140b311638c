"""Tone against plain loops over the picture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tone

SIZES = {1: (21, 17), 2: (8, 8), 3: (40, 9)}


def picture(frame):
    w, h = SIZES[frame]
    rng = np.random.default_rng(frame)
    return np.clip(rng.normal(120, 30, (h, w)) + np.arange(w) * 3, 0, 255).astype(int)


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(f, x, y, int(v)) for f in SIZES for (y, x), v in np.ndenumerate(picture(f))]
    return spark.createDataFrame([*rows, (1, None, 0, 5), (1, 0, 0, None), (None, 0, 0, 9), (1, 0, 0, 300)], "frame_id long, x int, y int, value int").withColumn("_w", F.lit(1)).repartition(4)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(f, w, h) for f, (w, h) in SIZES.items()], "frame_id long, width int, height int")


def images(df):
    out = {f: np.full(SIZES[f][::-1], -1) for f in SIZES}
    for r in df.collect():
        assert out[r["frame_id"]][r["y"], r["x"]] == -1
        out[r["frame_id"]][r["y"], r["x"]] = r["value"]
    return out


def rounded(x):
    return int(max(0, min(255, math.floor(round(x, 6) + 0.5))))


def plain_equalized(image, tiles, clip):
    h, w = image.shape
    tables = {}
    for ty in range(tiles):
        for tx in range(tiles):
            some = [int(image[y, x]) for y in range(h) for x in range(w) if min(y * tiles // h, tiles - 1) == ty and min(x * tiles // w, tiles - 1) == tx]
            if not some:
                continue
            counts = [some.count(v) for v in range(256)]
            limit = max(1, int(clip * len(some) / 256))
            over = sum(max(0, n - limit) for n in counts)
            counts = [min(n, limit) + over // 256 for n in counts]
            left = over % 256
            step = max(256 // max(left, 1), 1)
            for i in range(0, 256, step):
                if left > 0:
                    counts[i] += 1
                    left -= 1
            tables[ty, tx] = [max(0, min(255, math.floor(s * 255.0 / len(some) + 0.5))) for s in np.cumsum(counts).tolist()]
    out = image.copy()
    for y in range(h):
        for x in range(w):
            ay, ax = (y + 0.5) * tiles / h - 0.5, (x + 0.5) * tiles / w - 0.5
            total = weight = 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    ty, tx = math.floor(ay) + dy, math.floor(ax) + dx
                    k = (ay - math.floor(ay) if dy else 1 - ay + math.floor(ay)) * (ax - math.floor(ax) if dx else 1 - ax + math.floor(ax))
                    table = tables.get((max(0, min(tiles - 1, ty)), max(0, min(tiles - 1, tx))))
                    if table:
                        total, weight = total + k * table[image[y, x]], weight + k
            out[y, x] = rounded(total / weight)
    return out


@pytest.mark.parametrize(("tiles", "clip"), [(8, 2.0), (2, 1.0), (3, 40.0)])
def test_contrast_by_tile(pixels, frames, tiles, clip):
    got = images(tone.equalized(pixels, frames, tiles, clip))
    for f in SIZES:
        assert np.array_equal(got[f], plain_equalized(picture(f), tiles, clip))


def test_stretch(pixels):
    got = images(tone.stretched(pixels))
    for f in SIZES:
        image = picture(f)
        cum = np.cumsum(np.bincount(image.ravel(), minlength=256))
        low, high = max(1, int(np.argmax(cum >= image.size * 0.02))), int(np.argmax(cum >= image.size * 0.98))
        assert np.array_equal(got[f], np.vectorize(lambda v: rounded((v - low) * 255 / max(1, high - low)))(image))  # noqa: B023


def plain_blur(image, weights):
    r = len(weights) // 2
    for axis in (1, 0):
        n = image.shape[axis]
        image = sum(w * np.take(image, np.clip(np.arange(n) + k, 0, n - 1), axis=axis) for k, w in zip(range(-r, r + 1), weights, strict=True))
    return image


def test_sharpening_and_ink(pixels):
    sharp, ink = images(tone.sharpened(pixels)), images(tone.black_and_white(pixels, 15, 4))
    for f in SIZES:
        image = picture(f)
        blur = plain_blur(image.astype(float), tone.bell(tone.SIGMA))
        assert np.array_equal(sharp[f], np.vectorize(rounded)(image * (1 + tone.AMOUNT) - blur * tone.AMOUNT))
        around = plain_blur(image.astype(float), tone.bell(0.3 * ((15 - 1) * 0.5 - 1) + 0.8, 15))
        assert np.array_equal(ink[f], np.where(image > np.round(around, 6) - 4, 255, 0)) and 0 < (ink[f] == 0).sum()
    assert [tone.block(*s) for s in ((100, 50), (1568, 900), (720, 10))] == [15, 35, 17]


def test_no_pixels(spark, pixels, frames):
    none = pixels.limit(0)
    assert tone.equalized(none, frames).count() == tone.stretched(none).count() == tone.sharpened(none).count() == 0
