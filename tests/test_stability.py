"""Cluster stability against set arithmetic on rows."""

import math
import random

import numpy as np
import pytest

from panelforge.operators import stability as C


def test_best_matches_are_those_of_sets():
    dice = random.Random(4)
    for _ in range(20):
        full, sample = [dice.randrange(3) for _ in range(60)], [dice.randrange(4) for _ in range(60)]
        table = np.zeros((4, 4))
        for a, b in zip(full, sample, strict=True):
            table[a, b] += 1
        sets = lambda x: [{i for i, v in enumerate(x) if v == c} for c in range(4)]
        want = [max((len(a & b) / len(a | b) for b in sets(sample) if b), default=0) if a else 0.0 for a in sets(full)]
        assert np.allclose(C.best_matches(table), want)


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 4 == 0], *(rng.normal(0, 0.4, 2) + [(0, 0), (5, 1), (0, 6)][i % 3]).tolist()) for i in range(200)]
    return rows, spark.createDataFrame([*rows, (900, "a", None, 1.0)], "id long, s string, f double, g double").repartition(3)


def test_subsamples(spark, clusters):
    rows, df = clusters
    got = [tuple(r) for r in C.subsamples(df.filter("f IS NOT NULL"), "id", "s", 12, 0.8, 3).collect()]
    for r in range(12):
        mine = {i for i, q in got if q == r}
        for s in "ab":
            group = {x[0] for x in rows if x[1] == s}
            assert len(mine & group) == math.ceil(0.8 * len(group) - 1e-9)
    assert len(set(got)) == len(got) and len({frozenset(i for i, q in got if q == r) for r in range(12)}) == 12


def test_stability(spark, clusters):
    rows, df = clusters
    got = C.cluster_stability(df, "id", "s", ["f", "g"], [2, 3, 4], 15, 0.8, 3, starts=4).orderBy("cluster").collect()
    assert [r["k"] for r in got] == [3] * 3 and all(r["stable"] and r["mean_jaccard"] > 0.99 and r["k_share"] == 1.0 for r in got), got
    assert sorted(r["members"] for r in got) == [66, 67, 67]
    rng = np.random.default_rng(1)
    noise = spark.createDataFrame([(i, "a", *rng.normal(0, 1, 2).tolist()) for i in range(150)], "id long, s string, f double, g double")
    loose = C.cluster_stability(noise, "id", "s", ["f", "g"], [2, 3, 4], 15, 0.8, 3, starts=4).collect()
    assert not loose[0]["stable"] and sum(r["members"] for r in loose) == 150 and all(r["least_jaccard"] <= r["mean_jaccard"] <= r["largest_jaccard"] for r in loose)
    again = C.cluster_stability(noise.repartition(5), "id", "s", ["f", "g"], [2, 3, 4], 15, 0.8, 3, starts=4).collect()
    assert [r["mean_jaccard"] for r in again] == pytest.approx([r["mean_jaccard"] for r in loose])
