"""A passage in most documents: hot classes and anchors are settled apart, with the same result."""

import collections
import random

import numpy as np
import pytest

from panelforge.llm import repeats, substring, suffix


def made():
    rng = random.Random(11)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(120))
    texts = []
    for i in range(240):
        before, after = (" ".join(f"a{rng.randrange(9**6)}" for _ in range(rng.randrange(5, 40))) for _ in range(2))
        texts.append(f"{before} {passage} {after}" if i % 4 else f"{before} {after}")
    texts += [texts[1] + " more", "zz " + texts[2], passage, "again " * 200 + passage, passage + " again" * 200]
    return list(enumerate(texts))


@pytest.mark.parametrize("sample, least", [(1, 0.0), (3, 0.0), (64, 0.1)])
def test_hot_passages(spark, monkeypatch, sample, least):
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    monkeypatch.setattr(repeats, "HOT", least)
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = {i: t.split() for i, t in rows}
    seen = collections.Counter(tuple(x[k : k + 35]) for x in words.values() for k in range(len(x) - 34))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring.word_dedup(df).collect()}
    for i, x in words.items():
        gone = {p for k in range(len(x) - 34) if seen[tuple(x[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert got[i] == (len(x), len(gone), " ".join(v for p, v in enumerate(x) if p not in gone).encode())
    known, want = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in known:
                gone[k : k + 100] = True
            known.add(b[k : k + 100])
        want[i] = (int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix.byte_dedup(df).collect()} == want


def test_the_sample_finds_hot_classes(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string")
    heat = repeats._heat(df.mapInArrow(repeats._emit_runs(substring_shape()), repeats.RUN), 4)
    assert len(heat.classes) > 2 and (np.diff(heat.classes) > 0).all()


def substring_shape():
    return repeats.Shape("word", 35, 16, False)
