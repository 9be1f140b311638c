"""Ids of texts that spell a special token, against the JSON vocabulary left at its defaults."""

import zlib
from collections import Counter

import numpy as np

from tallyloom.llm import packing


def test_special_tokens_have_their_own_id(make):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| >", "<|ENDOFTEXT|>", "  <|endoftext|>  ", "it's <|endoftext|>'s 12", "plain", "é<|endoftext|>日本語"]
    want = Counter()
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        ids = np.array([*e.ids, packing.END], "<u4")
        want[(i, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    got = packing.pieces(make([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert Counter(map(tuple, got)) == want


def test_very_long_white_space_has_the_ids_of_the_vocabulary(make):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 1_200_000, "\n" * 1_200_000, "word " + " \n" * 600_000 + "é", "\t" * 1_000_000 + "<|endoftext|> x", "a" * 50_000]
    got = packing.pieces(make([(i, x, "s") for i, x in enumerate(texts)])).collect()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, packing.END], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == packing.CAPACITY for r in mine[1:])
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine]
