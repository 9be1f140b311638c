"""Fill-in-middle over ropes: a text is a balanced tree of short leaves, cut at two unit ranks and put together anew.

Leaves and inner nodes cache their numbers of units and of code points, so a cut at a unit rank, or at a code-point
rank, goes down one path of the tree and shares all other subtrees. The three parts are concatenated with sentinels in
between; the inverse cuts the output's tree at the sentinels and concatenates the parts in the order of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import doc_key

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many stay plain at the end of the range, and of the others so many have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
LEAF = 512


@dataclass(frozen=True, slots=True)
class Leaf:
    """Some code points of a text. ends: where its units end, None if each code point is a unit."""

    text: str
    ends: tuple[int, ...] | None

    @property
    def chars(self) -> int:
        return len(self.text)

    @property
    def units(self) -> int:
        return len(self.text) if self.ends is None else len(self.ends)

    @property
    def depth(self) -> int:
        return 0


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int
    depth: int


Rope = Leaf | Node
EMPTY = Leaf("", None)


def rope(text: str, unit: regex.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """A balanced rope of text. unit's matches are its units, from left to right, and every code point that no match
    covers is one too; without unit every code point is. A leaf holds about so many code points, and whole units."""
    if unit is None:
        leaves = [Leaf(text[i : i + leaf], None) for i in range(0, len(text), leaf)]
    else:
        leaves, at, ends = [], 0, []

        def close(to: int) -> None:
            nonlocal at, ends
            leaves.append(Leaf(text[at:to], tuple(e - at for e in ends)))
            at, ends = to, []

        done = 0
        for m in unit.finditer(text):
            for e in [*range(done + 1, m.start() + 1), *([m.end()] if m.end() > m.start() else [])]:
                ends.append(e)
                done = e
                if e - at >= leaf:
                    close(e)
        for e in range(done + 1, len(text) + 1):
            ends.append(e)
            if e - at >= leaf:
                close(e)
        if ends:
            close(len(text))
    while len(leaves) > 1:
        leaves = [join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def _node(left: Rope, right: Rope) -> Node:
    return Node(left, right, left.units + right.units, left.chars + right.chars, 1 + max(left.depth, right.depth))


def _balanced(left: Rope, right: Rope) -> Rope:
    """A node of two balanced trees whose depths differ by two at most, turned where they do."""
    if left.depth > right.depth + 1:
        if left.left.depth >= left.right.depth:
            return _node(left.left, _node(left.right, right))
        return _node(_node(left.left, left.right.left), _node(left.right.right, right))
    if right.depth > left.depth + 1:
        if right.right.depth >= right.left.depth:
            return _node(_node(left, right.left), right.right)
        return _node(_node(left, right.left.left), _node(right.left.right, right.right))
    return _node(left, right)


def join(left: Rope, right: Rope) -> Rope:
    """left followed by right, balanced if both are: the shallower one goes down the other's near edge."""
    if not left.chars:
        return right
    if not right.chars:
        return left
    if left.depth > right.depth + 1:
        return _balanced(left.left, join(left.right, right))
    if right.depth > left.depth + 1:
        return _balanced(join(left, right.left), right.right)
    return _node(left, right)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first rank units, or code points with by="chars", and the rest. A cut by code points must not part a unit."""
    size = getattr(tree, by)
    if rank <= 0:
        return EMPTY, tree
    if rank >= size:
        return tree, EMPTY
    if isinstance(tree, Leaf):
        if tree.ends is None:
            return Leaf(tree.text[:rank], None), Leaf(tree.text[rank:], None)
        k = rank if by == "units" else tree.ends.index(rank) + 1
        at = tree.ends[k - 1]
        return Leaf(tree.text[:at], tree.ends[:k]), Leaf(tree.text[at:], tuple(e - at for e in tree.ends[k:]))
    here = getattr(tree.left, by)
    if rank <= here:
        left, right = split(tree.left, rank, by)
        return left, join(right, tree.right)
    left, right = split(tree.right, rank - here, by)
    return join(tree.left, left), right


def flat(tree: Rope) -> str:
    """The text of a rope."""
    out: list[str] = []
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, Leaf):
            out.append(x.text)
        else:
            stack += (x.right, x.left)
    return "".join(out)


def arrange(tree: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """The rope's parts up to unit first, up to unit second and after it, put together as form asks for, with the code
    points of the first two."""
    prefix, rest = split(tree, first)
    middle, suffix = split(rest, second - first)
    p, s, m = (Leaf(x, None) for x in SENTINELS)
    parts = (p, prefix, s, suffix, m, middle) if form == PSM else (s, suffix, p, prefix, m, middle)
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return out, prefix.chars, middle.chars


def invert(output: str, form: str) -> str:
    """The text that arrange() made output of; plain texts are their own output."""
    if form == PLAIN:
        return output
    tree = rope(output)
    between = SUFFIX if form == PSM else PREFIX
    second = output.index(between, len(PREFIX))  # texts that hold a sentinel stay plain, so the first found is ours
    third = output.index(MIDDLE, second)
    head, rest = split(tree, second, "chars")
    one = split(head, len(PREFIX), "chars")[1]
    mid, last = split(rest, third - second, "chars")
    two = split(mid, len(between), "chars")[1]
    middle = split(last, len(MIDDLE), "chars")[1]
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return flat(join(join(prefix, middle), suffix))


def draws(doc_id: Column) -> list[Column]:
    """Four 32-bit numbers of a document's id; rows without an id share those of the word null."""
    digest = F.sha2(F.concat(F.lit("1:"), doc_key(doc_id)), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, unit: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    n counts the text's units: matches of unit, or code points without it. A null text is empty. Empty texts and texts
    that hold a sentinel stay plain, with null prefix_chars and middle_chars. Rows with one id and text have one
    result, and so have all rows of a text without an id. An empty table gives no rows; further columns are not looked at.
    """
    h = draws(F.col("doc_id"))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 >= PLAIN_FROM).alias("plain"),
        F.when(h[3] % 100 < SPM_BELOW, SPM).otherwise(PSM).alias("form"),
    )
    pattern = None if unit is None else regex.compile(unit)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut_up(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, h1, h2, plain, form in batches:
            out = []
            for t, a, b, stays, f in zip(text, h1.tolist(), h2.tolist(), plain.tolist(), form, strict=True):
                tree = rope(t, pattern, leaf)
                n = tree.units
                if stays or not t or any(x in t for x in SENTINELS):
                    out.append((n, PLAIN, None, None, t))
                    continue
                a, b = sorted((a % (n + 1), b % (n + 1)))
                made, prefix, middle = arrange(tree, a, b, f)
                out.append((n, f, prefix, middle, flat(made)))
            frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = rows.select("doc_id", cut_up("text", "h1", "h2", "plain", "form").alias("_made"))
    return made.select("doc_id", "_made.*")


def restored(output: Column, form: Column) -> Column:
    """The texts that transformed() took, from its output and form."""

    @F.pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([invert(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return back(output, form)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """transformed() over code points, with digests of the output and of the text rebuilt from it."""
    out = transformed(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
