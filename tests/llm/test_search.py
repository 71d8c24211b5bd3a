"""Ranked search against scores counted one by one; the trees against sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def plain(docs, items, k=10):
    words = [terms(t) for _, t in docs]
    n_docs, length = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w in zip(docs, words, strict=True):
            tf = Counter(w)
            m = 25 + 75 * len(w) * n_docs // length if w else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **how):
    got = search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("shard, fan, block", [(4096, 32, 4 << 20), (7, 2, 4 << 20), (50, 4, 200)])
def test_against_plain_scores(spark, monkeypatch, shard, fan, block):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "FAN", fan)
    dice = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["École", "ÉCOLE", "Straße", "x9", "UP", "up"]
    text = lambda n: dice.choice([" ", ", ", "\n"]).join(dice.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(dice.choice([i, i, i, None]), text(dice.choice([0, 1, 3, 8, 30]))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + docs[:9] + [(77, None), (78, "..."), (79, "w1 " * 4000)]
    items = [(i, text(dice.choice([1, 4, 20]))) for i in range(12)] + [(1, "w0 w0 up"), (None, "w3 w39"), (50, None), (51, "absent"), (52, docs[5][1])]
    monkeypatch.setattr(search, "PIECE", 1000)
    assert ranked(spark, docs, items, block_bytes=block) == plain(docs, items)
    assert ranked(spark, docs, items[:3], k=1) == plain(docs, items[:3], 1)


def test_small_tables(spark):
    items = [(1, "alpha beta")]
    assert ranked(spark, [], items) == [] and ranked(spark, [(1, None), (2, "?!")], items) == []
    assert ranked(spark, [(1, "alpha")], []) == [] and ranked(spark, [(1, "alpha")], [(1, None)]) == []
    assert ranked(spark, [(1, "alpha"), (2, "gamma")], items) == plain([(1, "alpha"), (2, "gamma")], items)
    odd = spark.createDataFrame([(1, "alpha", 5, 6, 7)], "doc_id long, text string, shard int, item int, _file int")
    same = spark.createDataFrame([(1, "alpha", 5, 6)], "item_id long, text string, doc_id int, score int")
    assert [tuple(r)[:3] for r in search.ranked_search(odd, same).collect()] == [(1, 1, 1)]


def test_trees_leave_out_what_cannot_win():
    dice = np.random.default_rng(2)
    docs, kinds = 1024, 5
    place = [np.sort(dice.choice(docs, 300, replace=False)) for _ in range(kinds)]
    row = {"ids": list(range(docs)), "lens": dice.integers(5, 50, docs).astype(np.int64).tobytes(), "terms": np.arange(kinds, dtype=np.int32).tobytes(), "starts": (np.arange(kinds + 1) * 300).astype(np.int64).tobytes(), "place": np.concatenate(place).astype(np.int32).tobytes(), "tf": dice.integers(1, 9, 300 * kinds).astype(np.int64).tobytes()}
    trees = search.Trees(row, search.Stats(docs, docs * 20, np.array([900, 50, 40, 30, 10])))
    block, value, _ = trees.levels[0]
    score = np.bincount(block, weights=value, minlength=docs).astype(int)
    q = search.Queries({}, np.array([0, kinds]), np.arange(kinds), np.ones(kinds, np.int64))
    root, _, bound = trees.roots(q)
    want = sorted(((-s, i) for i, s in enumerate(score.tolist()) if s > 0))[:10]
    assert bound[0] >= score.max() and trees.best(root, np.ones(kinds, np.int64), int(bound[0]), 0, 10) == [(-s, i) for s, i in want]
    least = -want[3][0]
    assert trees.best(root, np.ones(kinds, np.int64), int(bound[0]), least, 10) == [(-s, i) for s, i in want if -s >= least]
    assert trees.best(root, np.ones(kinds, np.int64), int(bound[0]), int(bound[0]) + 1, 10) == []
