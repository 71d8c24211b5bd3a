"""Planted links just over the threshold, templated pages and large families."""

import random

import numpy as np
import pytest

from panelforge.llm import minhash


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"n{rng.randrange(10**7)}"
    return out


def sets_of(texts):
    return [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]


@pytest.mark.parametrize("percent", [80, 85])
def test_planted_links_are_found(spark, percent):
    rng = random.Random(percent)
    texts, pairs = [], []
    for _ in range(2500):
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(60, 300))]
        other = base + [f"t{rng.randrange(10**6)}" for _ in range(int((len(base) - 4) * (100 / percent - 1)))]  # as far apart as linked texts can be
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(other)]
    sets = sets_of(texts)
    near = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert len(near) > 2400 and sum(got[b] == a for a, b in near) >= 0.99 * len(near)


@pytest.mark.parametrize("docs", [12, 4096])
def test_templated_pages(spark, monkeypatch, docs):
    """Pages of one template with their own content, some of them near copies of each other: exact groups, large family or not."""
    monkeypatch.setattr(minhash, "FAMILY_DOCS", docs)
    rng = random.Random(8)
    frame = [f"f{i}" for i in range(130)]
    texts = []
    for _ in range(150):
        own = [f"c{rng.randrange(10**7)}" for _ in range(70)]
        texts.append(" ".join(frame + own))
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            texts.append(" ".join(frame + edited(own, rng.randrange(0, 6), rng)))
    rng.shuffle(texts)
    sets = sets_of(texts)
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) >= 140


def test_rarest_shingles_lose_no_link():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[: rng.integers(90, 120)], rng.integers(0, 1 << 62, rng.integers(0, 25)).astype(np.uint64)])) for _ in range(60)]
        root = list(range(60))
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in minhash.linked(np.arange(60), sets, percent):
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = list(range(60))
        top = lambda x: x if want[x] == x else top(want[x])
        for a in range(60):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    want[max(top(a), top(b))] = min(top(a), top(b))
        assert [find(i) for i in range(60)] == [top(i) for i in range(60)]
