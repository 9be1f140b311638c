"""Wu-Manber search of many byte strings at once, over a whole buffer of texts.

A class holds the strings whose lengths lie between two powers of two; m is its shortest. Of each string the first m
bytes count for shifting: a table says by the hash of the block of bytes at the end of a place how far no string can
begin in between. Where the shift is 0 the bucket of that hash names the strings to try, and these are compared byte by
byte. The buffer is cut into lanes that are searched side by side, one step of all lanes an array operation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np

BLOCK = 8
LANE = 512
LONGEST = 4096
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Class:
    """Shift table and buckets of strings of about one length. strings: (index, bytes)."""

    def __init__(self, strings: Sequence[tuple[int, bytes]]) -> None:
        self.m = m = min(LONGEST, min(len(s) for _, s in strings))
        self.block = b = min(BLOCK, max(1, (m + 1) // 2))
        self.mask = np.uint64((1 << 8 * b) - 1 if b < 8 else 2**64 - 1)
        heads = np.frombuffer(b"".join(s[:m] + bytes(8) for _, s in strings), np.uint8).reshape(len(strings), m + 8)
        grams = np.lib.stride_tricks.sliding_window_view(heads, 8, axis=1)[:, : m - b + 1]
        values = np.ascontiguousarray(grams).view("<u8")[:, :, 0] & self.mask
        self.bits = np.uint64(64 - min(22, max(12, int(np.ceil(np.log2(8 * max(1, np.unique(values).size)))))))
        hashed = self.hash(values)
        self.shift = np.full(1 << int(np.uint64(64) - self.bits), m - b + 1, np.int32)
        for j in range(m - b + 1):  # from the far end of the head to the near one, so that the smallest stays
            self.shift[hashed[:, j]] = m - b - j
        buckets = defaultdict(list)
        for (index, s), h in zip(strings, hashed[:, -1].tolist(), strict=True):
            buckets[h].append((index, s))
        self.buckets = dict(buckets)

    def hash(self, values: np.ndarray) -> np.ndarray:
        return ((values * _SPREAD) >> self.bits).astype(np.int64)

    def ends(self, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where the head of a string may begin, and the hashes of their last blocks. grams: the 8 bytes from
        each place on; size: the buffer's bytes without its padding."""
        m, b = self.m, self.block
        starts = np.arange(0, max(0, size - m + 1), LANE)
        stop = np.minimum(starts + LANE, size - m + 1) + m - b
        at = starts + m - b  # where the last block of a head that begins here begins
        found, hashes = [], []
        while at.size:
            h = self.hash(grams[at] & self.mask)
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                found.append(at[zero] - (m - b))
                hashes.append(h[zero])
            at = at + np.maximum(step, 1)
            more = at < stop
            if not more.all():
                at, stop = at[more], stop[more]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(hashes)


class Matcher:
    """Finds every occurrence of each of the strings, none of them empty."""

    def __init__(self, strings: Sequence[bytes]) -> None:
        self.strings = strings
        classes = defaultdict(list)
        for i, s in enumerate(strings):
            classes[min(len(s), LONGEST).bit_length()].append((i, s))
        self.classes = [_Class(c) for c in classes.values()]

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of occurrences and the indexes of the strings that occur there, in no order."""
        padded = text + bytes(8)
        grams = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
        places: list[int] = []
        which: list[int] = []
        for c in self.classes:
            for at, h in zip(*(x.tolist() for x in c.ends(grams, len(text))), strict=True):
                for index, s in c.buckets.get(h, ()):
                    if text.startswith(s, at):
                        places.append(at)
                        which.append(index)
        return np.array(places, np.int64), np.array(which, np.int64)
