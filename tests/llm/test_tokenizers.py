"""Packing with a tokenizer whose pre-tokens span white space: its texts are encoded whole."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest

from panelforge.llm import packing

TEXTS = ["Two  words here. And\tmore!", "", None, "x" * 300 + " y" * 9000, "\u00c9t\u00e9 \u0130 \u03a3\u0391\u03a3", "a\x1cb <|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_tokenizer(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    assert packing.Encoder(path).whole == name.startswith("byte")
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in TEXTS]
    got = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert {i: sorted(x) for i, x in pieces.items()} == {i: list(range(len(x))) for i, x in enumerate(ids)}
