"""Rank statistics, corrections and exact tests over range partitions, against plain loops."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import stats as S
from panelforge.operators import models as M
from panelforge.operators import resample as R


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(2)
    made = [(g, i, dice.choice([0.001, 0.002, 0.01, 0.01, 0.04, 0.3, 0.9])) for g in "ab" for i in range(60)]
    return made, spark.createDataFrame(made, "g string, id long, p double").repartition(5)


def test_corrections(rows):
    made, df = rows
    q = {(r["g"], r["id"]): r["q"] for r in S.false_discovery(df, ["g"], "p").collect()}
    sig = {(r["g"], r["id"]): r["significant"] for r in S.step_down(df, ["g"], "p", 0.3).collect()}
    for g in "ab":
        mine = sorted((p, i) for x, i, p in made if x == g)
        n, good = len(mine), True
        for k, (p, i) in enumerate(mine):
            raw = [r * n / (sum(s < r for s, _ in mine) + 1) for r, _ in mine if r >= p]
            assert q[g, i] == pytest.approx(min(1.0, min(raw)))
            good = good and p <= 0.3 / (n - k)
            assert sig[g, i] == good


def test_average_ranks(rows):
    made, df = rows
    got = {(r["g"], r["id"]): r["rank"] for r in S.average_rank(df, ["g"], "p", "rank").collect()}
    for g, i, p in made:
        mine = [x for h, _, x in made if h == g]
        assert got[g, i] == sum(x < p for x in mine) + (sum(x == p for x in mine) + 1) / 2


def test_sign_tests_of_any_size(spark):
    cases = [(0, 0), (0, 1), (1, 1), (3, 10), (5, 10), (60, 61), (400, 1000), (1500, 3000)]
    got = {(r["k"], r["n"]): r["p"] for r in R.sign_tests(spark.createDataFrame(cases, "k long, n long"), "k", "n").collect()}
    for k, n in cases:
        tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
        assert got[k, n] == pytest.approx(float(min(Fraction(1), Fraction(2 * tail, 2**n))), rel=1e-9)


def test_shuffled_labels_keep_their_strata(spark):
    df = spark.createDataFrame([(s, s * 100 + i, (i * 7 + s) % 5) for s in range(3) for i in range(40)], "s long, k long, y long").repartition(4)
    got = R.label_shuffle(df, ["s"], "k", "y", 30, 5).collect()
    labels = {s: sorted((i * 7 + s) % 5 for i in range(40)) for s in range(3)}
    seen = set()
    for r in range(30):
        for s in range(3):
            mine = sorted((x["k"], x["y"]) for x in got if x["replicate"] == r and x["s"] == s)
            assert [k for k, _ in mine] == [s * 100 + i for i in range(40)] and sorted(y for _, y in mine) == labels[s]
            seen.add(tuple(y for _, y in mine))
    assert len(seen) > 85
    u = lambda r: dict(map(tuple, df.select("k", R.uniform(F.lit(5), F.lit(r), "k")).collect()))
    order = sorted((v, k) for k, v in u(4).items() if k < 100)
    first = {k: y for _, k, y in df.collect()}
    assert [x["y"] for x in sorted((x for x in got if x["replicate"] == 4 and x["s"] == 0), key=lambda x: x["k"])] == [first[k] for _, k in order]


def test_judged_silhouettes(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal([6, 0], 1, (300, 2))])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key long, x array<double>").repartition(3)
    centres = {2: np.array([[0.0, 0], [6.0, 0]])}
    exact = M.silhouette(x, M._squares(x, centres[2]).argmin(1))
    assert M.silhouettes(points, centres, block=100)[2] == pytest.approx(exact)
    assert M.silhouettes(points, centres, block=100, judged=200)[2] == pytest.approx(exact, abs=0.05)
