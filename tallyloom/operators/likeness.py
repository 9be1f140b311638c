"""Scores of many names in many texts at once, over arrays: names.score_name is what they are held against.

Names and texts are folded, so a letter is one of LETTERS. Distances of whole blocks of names and texts are bounded from
below in fifths of an edit, and only pairs whose bound leaves room for a score are scored, by the same sums in the same
order as score_name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
PAD = len(LETTERS)
#: Pairs that are bounded together, so that their columns stay in a core's cache, and strings compared together.
TOGETHER, STRINGS = 1 << 18, 1 << 13
_CODE = np.full(256, PAD, np.uint8)
_CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(PAD, dtype=np.uint8)


def coded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of letter numbers, filled up with PAD, and their lengths."""
    sizes = np.array([len(s) for s in strings], np.int64)
    width = max(1, int(sizes.max(initial=0)))
    return _CODE[np.array(strings, f"S{width}").view(np.uint8).reshape(len(strings), width)], sizes


def costs(confused: tuple[tuple[str, str], ...], cost: float) -> np.ndarray:
    """What it costs to take a letter for another."""
    out = np.ones((PAD + 1, PAD + 1))
    np.fill_diagonal(out[:PAD, :PAD], 0.0)
    for x, y in confused:
        i, j = LETTERS.index(x), LETTERS.index(y)
        out[i, j] = out[j, i] = cost
    return out


def least(tokens: np.ndarray, sizes: np.ndarray, texts: np.ndarray, swaps: np.ndarray) -> np.ndarray:
    """(text, token): five times the least distance of a token to anything that stands in a text, at any place and of any
    length, so that no word and no window of the text is nearer. Tokens are in the order of their sizes; swaps are
    costs in fifths."""
    longest = int(sizes[-1])
    kind = np.uint8 if longest <= 50 else np.uint16 if longest <= 13_000 else np.uint32
    by_place = [swaps.astype(kind)[:, tokens[:, i]] for i in range(longest)]
    ends = {int(n): (np.searchsorted(sizes, n), np.searchsorted(sizes, n, "right")) for n in np.unique(sizes)}
    out = np.empty((len(texts), len(sizes)), kind)
    for at, x in ((at, texts[at]) for at in np.array_split(np.arange(len(texts)), -(-len(texts) * len(sizes) // TOGETHER))):
        old = [np.full((len(x), len(sizes)), 5 * i, kind) for i in range(longest + 1)]
        new, other = [old[0], *map(np.empty_like, old[1:])], np.empty_like(old[0])
        best = np.repeat((5 * sizes).astype(kind)[None, :], len(x), 0)
        for j in range(int((x != PAD).sum(1).max(initial=0))):
            for i in range(1, longest + 1):
                np.take(by_place[i - 1], x[:, j], 0, new[i], "clip")
                new[i] += old[i - 1]
                np.minimum(old[i], new[i - 1], other)
                np.add(other, kind(5), other)
                np.minimum(new[i], other, new[i])
            for n, (first, last) in ends.items():
                np.minimum(best[:, first:last], new[n][:, first:last], best[:, first:last])
            old, new = new, old
        out[at] = best
    return out


def distances(a: np.ndarray, b: np.ndarray, swap: np.ndarray) -> np.ndarray:
    """The distance of each row of a to the same row of b; rows of either have one length."""
    out, flat = np.empty(len(a)), swap.ravel()
    for at in range(0, len(a), STRINGS):
        x, y = a[at : at + STRINGS].T.astype(np.int64) * (PAD + 1), b[at : at + STRINGS].T.astype(np.int64)
        row = [np.full(x.shape[1], float(j)) for j in range(len(y) + 1)]
        for i in range(len(x)):
            above, row[0] = row[0], np.full(x.shape[1], float(i + 1))
            for j in range(len(y)):
                swapped = flat.take(x[i] + y[j])
                swapped += above
                above = row[j + 1]
                step = np.minimum(above, row[j])
                step += 1
                row[j + 1] = np.minimum(step, swapped, step)
        out[at : at + STRINGS] = row[-1]
    return out


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the parts that rows have: the row, and the part's number within it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class Scorer:
    """Scores of names (their significant words) in texts (folded words); see names.score_name for the rules."""

    def __init__(self, confused: tuple[tuple[str, str], ...], cost: float, first: float, missing: float, present: float, confirmed: float) -> None:
        self.swap, self.first, self.missing, self.present, self.confirmed = costs(confused, cost), first, missing, present, confirmed
        self.fifths = np.floor(self.swap * 5 + 1e-9)

    def hits(self, names: list[str], texts: list[str], meet: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(name, text, score, confirmed, led) by number, for pairs whose rounded score is the confirming one or more; led
        tells whether the name's first word is there. meet has groups of names and of texts, each name of a group to be
        looked for in each of its texts."""
        self._read(names, texts)
        pairs = [self._possible(n, t) for n, t in meet if len(n) and len(t)]
        both = np.unique(np.concatenate([n * len(texts) + t for n, t in pairs])) if pairs else np.empty(0, np.int64)
        n, t = both // max(1, len(texts)), both % max(1, len(texts))
        score, led = self._scores(n, t)
        rounded = np.floor(score * 1000 + 0.5) / 1000
        kept = rounded >= self.confirmed
        return n[kept], t[kept], rounded[kept], score[kept] >= self.confirmed, led[kept]

    def _read(self, names: list[str], texts: list[str]) -> None:
        split = [n.split(" ") if n else [] for n in names]
        tokens = sorted({w for ws in split for w in ws}, key=lambda w: (len(w), w))
        number = {w: i for i, w in enumerate(tokens)}
        self.token, self.size = coded(tokens)
        self.of = np.full((len(names), max((len(ws) for ws in split), default=0)), -1, np.int64)
        for i, ws in enumerate(split):
            self.of[i, : len(ws)] = [number[w] for w in ws]
        there = self.of >= 0
        self.weight = np.where(there, self.size[self.of] if len(tokens) else 0, 0).astype(float)
        self.weight[:, :1] *= self.first
        self.text, self.length = coded(texts)
        split = [t.split(" ") if t else [] for t in texts]
        words = sorted({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(words)}
        self.word, self.word_size = coded(words)
        self.words = np.array([len(ws) for ws in split], np.int64)
        self.word_of = np.array([number[w] for ws in split for w in ws], np.int64)
        self.word_at = np.cumsum(self.words) - self.words
        self.longest = np.array([max(map(len, ws), default=0) for ws in split], np.int64)

    def _possible(self, names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose bounds leave room for the confirming score."""
        tokens = np.unique(self.of[names])
        tokens = tokens[tokens >= 0]
        if not len(tokens):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size, of = self.size[tokens], np.searchsorted(tokens, self.of[names])
        place, owner = np.nonzero(self.of[names].T >= 0)
        token = of[owner, place]
        order = np.argsort(token, kind="stable")
        owner, owners = owner[order], np.bincount(token, minlength=len(tokens))
        first = np.cumsum(owners) - owners
        found = []
        for some in np.array_split(texts, -(-len(texts) * len(tokens) // (4 * TOGETHER))):
            low = least(self.token[tokens], size, self.text[some], self.fifths)
            # a score asks for one word at least that is as near; a word of the text that is longer than the token makes
            # the same distance count less
            length = [np.clip(self.longest[some], n, int(1.6 * n + 1e-6)) for n in range(int(size[-1]) + 1)]
            near = np.empty(low.shape, bool)
            for n in np.unique(size):
                here = slice(np.searchsorted(size, n), np.searchsorted(size, n, "right"))
                near[:, here] = low[:, here] <= (5 * (1 - self.confirmed + 1e-3) * length[n])[:, None].astype(low.dtype)
            t, k = np.nonzero(near)
            row, at = _spread(owners[k])
            both = np.unique(t[row] * len(names) + owner[first[k[row]] + at])
            t, n = both // len(names), both % len(names)
            got, total, light = (np.full(len(t), x) for x in (0.0, 0.0, np.inf))
            for p in range(of.shape[1]):
                there = self.of[names[n], p] >= 0
                k, weight = np.where(there, of[n, p], 0), self.weight[names[n], p]
                s = np.where(there, 1 - low[t, k] / (5 * np.clip(self.longest[some[t]], size[k], np.floor(1.6 * size[k] + 1e-6))), 0.0)
                got += s * weight
                total += weight
                light = np.where(s >= self.present - 1e-9, np.minimum(light, weight), light)  # the lightest word that may be there
            base = np.where(np.isinf(light), total, self.missing * total + (1 - self.missing) * np.where(np.isinf(light), 0, light))
            kept = got >= (self.confirmed - 1e-3) * base
            found.append((names[n[kept]], some[t[kept]]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _scores(self, names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores that are not rounded, and whether the first word is there."""
        total, got, there, gone = (np.zeros(len(names)) for _ in range(4))
        led = np.zeros(len(names), bool)
        for p in range(self.of.shape[1]):
            token, weight = self.of[names, p], self.weight[names, p]
            here = np.flatnonzero(token >= 0)
            pairs, back = np.unique(token[here] * len(self.length) + texts[here], return_inverse=True)
            s = self._best(pairs // len(self.length), pairs % len(self.length))[back]
            w = weight[here]
            total[here] += w
            got[here] += s * w
            there[here] += np.where(s >= self.present, w, 0.0)
            gone[here] += np.where(s >= self.present, 0.0, w)
            if p == 0:
                led[here] = s >= self.present
        base = np.where(there > 0, there + self.missing * gone, total)
        return np.minimum(1.0, np.divide(got, base, out=np.zeros(len(names)), where=base != 0)), led

    def _best(self, token: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best likeness of a token to a word of a text, or to a window of the token's length where no word is
        near enough."""
        best = np.zeros(len(token))
        row, k = _spread(self.words[text])
        t, w = token[row], self.word_of[self.word_at[text[row]] + k]
        near = np.abs(self.word_size[w] - self.size[t]) <= 0.6 * self.size[t]
        row, pairs = row[near], t[near] * len(self.word_size) + w[near]
        some, back = np.unique(pairs, return_inverse=True)
        np.maximum.at(best, row, self._alike(some // len(self.word_size), self.word, self.word_size, some % len(self.word_size))[back])
        weak = np.flatnonzero(best < self.present)
        for part in np.array_split(weak, -(-len(weak) // STRINGS) or 1):
            row, start = _spread(np.maximum(0, self.length[text[part]] - self.size[token[part]] + 1))
            row = part[row]
            for n in np.unique(self.size[token[row]]):
                here = np.flatnonzero(self.size[token[row]] == n)
                r = row[here]
                windows = self.text[text[r][:, None], start[here][:, None] + np.arange(n)]
                likeness = np.maximum(0.0, 1 - distances(self.token[token[r], :n], windows, self.swap) / n)
                np.maximum.at(best, r, likeness)
        return best

    def _alike(self, token: np.ndarray, strings: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token))
        shape = self.size[token] * (sizes.max(initial=0) + 1) + sizes[which]
        for s in np.unique(shape):
            here = np.flatnonzero(shape == s)
            n, m = int(self.size[token[here[0]]]), int(sizes[which[here[0]]])
            out[here] = np.maximum(0.0, 1 - distances(self.token[token[here], :n], strings[which[here], :m], self.swap) / max(n, m))
        return out


def scored(scorer: Scorer, texts: pa.Table, names: pa.Table) -> pa.Table:
    """Hits of texts (block, id, words) and names (block, company_id, active, tokens) that share a block."""

    def numbered(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
        found = column.combine_chunks().dictionary_encode()
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    text, text_of = numbered(texts["words"])
    name, name_of = numbered(names["tokens"])
    blocks = pa.chunked_array([*texts["block"].chunks, *names["block"].chunks])
    _, block = numbered(blocks)
    left, right = block[: len(text_of)], block[len(text_of) :]
    groups = lambda key, of: {k: np.unique(of[rows]) for k, rows in _rows_by(key).items()}
    by_text, by_name = groups(left, text_of), groups(right, name_of)
    n, t, score, sure, led = scorer.hits(name, text, [(by_name[b], by_text[b]) for b in by_name.keys() & by_text.keys()])
    # every row of a text with every row of a name
    ids, companies = _distinct(texts.select(["id"]), text_of), _distinct(names.select(["company_id", "active"]), name_of)
    of_text, of_name = _rows_by(ids[1]), _rows_by(companies[1])
    both = [(a, b, i) for i, (x, y) in enumerate(zip(t.tolist(), n.tolist(), strict=True)) for a in of_text[x] for b in of_name[y]]
    a, b, i = (np.array(c, np.int64) for c in zip(*both, strict=True)) if both else (np.empty(0, np.int64),) * 3
    c = companies[0].take(b)
    return pa.table({"id": ids[0]["id"].take(a), "company_id": c["company_id"], "active": c["active"], "score": score[i], "confirmed": sure[i], "led": led[i]})


def _rows_by(key: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, first[1:]), strict=True)) if len(key) else {}


def _distinct(table: pa.Table, number: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """A table's distinct rows with their numbers."""
    once = table.append_column("_n", pa.array(number)).group_by([*table.column_names, "_n"]).aggregate([])
    return once.drop_columns(["_n"]), once["_n"].to_numpy()
