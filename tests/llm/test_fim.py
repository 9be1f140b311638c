"""Ropes against string slices, and the query's columns against a plain reading of the same rules."""

import hashlib

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import fim
from tests.llm.conftest import ODD

TEXT = st.text(alphabet=st.sampled_from("ab<PSM> é日\U0001f600\n"), max_size=60)




@given(TEXT, st.integers(1, 7), st.integers(-2, 70))
@settings(max_examples=200, deadline=None)
def test_a_cut_by_units_is_a_slice(text, leaf, rank):
    left, right = fim.split(fim.rope(text, None, leaf), rank)
    assert (fim.flat(left), fim.flat(right)) == (text[: max(0, rank)], text[max(0, rank) :])
    assert (left.units, right.chars) == (len(fim.flat(left)), len(fim.flat(right)))


@given(TEXT, st.integers(1, 7), st.integers(0, 70))
@settings(max_examples=200, deadline=None)
def test_units_of_a_pattern_stay_whole(text, leaf, rank):
    pattern = regex.compile(r"[ab]+|\X")
    units, at = [], 0
    for m in pattern.finditer(text):
        units += [*text[at : m.start()], m.group()]
        at = m.end()
    units += text[at:]
    tree = fim.rope(text, pattern, leaf)
    left, right = fim.split(tree, rank)
    assert (tree.units, tree.chars) == (len(units), len(text))
    assert (fim.flat(left), fim.flat(right)) == ("".join(units[:rank]), "".join(units[rank:]))
    assert tuple(map(fim.flat, fim.split(tree, left.chars, "chars"))) == (fim.flat(left), fim.flat(right))


@given(TEXT.filter(lambda t: not any(s in t for s in fim.SENTINELS)), st.integers(0, 60), st.integers(0, 60), st.sampled_from([fim.PSM, fim.SPM]))
@settings(max_examples=300, deadline=None)
def test_the_inverse_gives_the_text_back(text, a, b, form):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    out, prefix, middle = fim.arrange(fim.rope(text, None, 5), a, b, form)
    p, m, s = text[:a], text[a:b], text[b:]
    assert fim.flat(out) == (f"<P>{p}<S>{s}<M>{m}" if form == fim.PSM else f"<S>{s}<P>{p}<M>{m}")
    assert (prefix, middle) == (a, b - a)
    assert fim.invert(fim.flat(out), form) == text


def test_joined_ropes_stay_shallow():
    tree = fim.EMPTY
    for i in range(3000):
        tree = fim.join(tree, fim.Leaf(str(i), None))
    assert tree.depth <= 17 and fim.flat(tree) == "".join(map(str, range(3000)))


def plain_reading(doc_id, text):
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, a, b = "plain", text, None, None
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, a, None if a is None else b - a, digest(out), digest(text)


@pytest.fixture(scope="module")
def rows():
    return [*ODD, *((100 + i, t, "s") for i, t in enumerate(["a<P>b", "<S", "<M>", "<", "P>x<S", "<<S>>", "a\r\nb"] * 8)), (900, "\U0001f600é" * 40_000, "s")]


def test_rows_against_a_plain_reading(make, rows):
    got = fim.fill_in_middle(make(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_reading(i, t)) for i, t, _ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_an_empty_table(make):
    out = fim.fill_in_middle(make([]))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert out.count() == 0
