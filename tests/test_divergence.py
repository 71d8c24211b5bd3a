"""Distances of label shares with intervals, nulls and windows, and logistic fits, against plain arithmetic."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import logistic as L
from panelforge.operators import occupancy as O


def js(p, q):
    p, q = np.asarray(p, float) / np.sum(p), np.asarray(q, float) / np.sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return np.sqrt(max((part(p) + part(q)) / 2, 0))


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(3)
    return [(dt.date(2020, 1, 1) + dt.timedelta(days=i), int(rng.choice(3, p=[0.6, 0.3, 0.1]))) for i in range(120)], [(dt.date(2021, 1, 1) + dt.timedelta(days=i), int(rng.choice([0, 1, 3]))) for i in range(30)]


def test_bootstrap(spark, labelled):
    base, goal = labelled
    frames = [spark.createDataFrame(x, "day date, label int").repartition(3) for x in labelled]
    got = O.divergence_bootstrap(*frames, "day", "label", 60, 7, 5).first()
    hist = lambda v: np.bincount(v, minlength=4)
    lab, q = np.array([v for _, v in base]), hist([v for _, v in goal])
    draws = O.block_draws(frames[0], 60, 120 // 7, 114, 5).toPandas()
    boot = [js(sum(hist(lab[s - 1 : s + 6]) for s in part["start"]), q) for _, part in draws.groupby("replicate")]
    assert draws["start"].between(1, 114).all() and len(draws) == 60 * 17 and len(boot) == 60
    assert got["observed"] == pytest.approx(js(hist(lab), q)) and got["low"] == pytest.approx(np.percentile(boot, 2.5)) and got["high"] == pytest.approx(np.percentile(boot, 97.5))
    halves = O.replicated(O.numbered_rows(frames[0], "day"), 60).withColumn("coin", O.uniform(F.lit(6), "replicate", "nth") < 0.5).toPandas()
    null = [js(hist(p[p["coin"]]["label"]), hist(p[~p["coin"]]["label"])) for _, p in halves.groupby("replicate")]
    assert got["null_p95"] == pytest.approx(np.percentile(null, 95)) and got["exceeds"] == (got["observed"] > got["null_p95"])
    few = O.divergence_bootstrap(frames[0].filter("day < DATE'2020-01-04'"), frames[1], "day", "label", 5, 7, 5).first()
    assert few["low"] is None and few["observed"] is not None


def test_windows(spark):
    days = [dt.date(2020, 12, 15) + dt.timedelta(days=i) for i in range(40)]
    rows = [(d, None if i == 30 else (i * i) % 3) for i, d in enumerate(days) if i != 5]
    df = spark.createDataFrame(rows, "day date, label int")
    got = {r["start"]: r["js"] for r in O.window_distances(df, "day", "label", F.year("day") == 2020).collect()}
    known = dict(rows)
    q = np.bincount([v for d, v in rows if d.year == 2020 and v is not None], minlength=3)
    want = {}
    for d in days:
        span = [d + dt.timedelta(days=i) for i in range(7)]
        if span[0].year == span[-1].year and all(known.get(x) is not None for x in span):
            want[d] = js(np.bincount([known[x] for x in span], minlength=3), q)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    twice = O.window_distances(df.unionByName(df.limit(1)), "day", "label", F.year("day") == 2020).collect()
    assert all(r["start"] != days[0] for r in twice)
    other = O.window_distances(df.withColumn("label", F.when(F.col("day") == days[20], 9).otherwise(F.col("label"))), "day", "label", F.col("day") < days[10])
    assert other.filter(F.col("start") == days[18]).first()["js"] > 0


def test_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, [1, 5, 0.2], (400, 3)) + [0, 30, 1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.2, -0.3, 2.0] + 6)))).astype(int)
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    df = spark.createDataFrame(frame).repartition(5)
    for c in (0.01, 1.0, 100.0):
        fit = L.fitted(df, ["a", "b", "c"], "y", c)
        beta = np.array([*fit.weights, fit.intercept])
        z = np.column_stack([x, np.ones(400)])
        p = 1 / (1 + np.exp(-z @ beta))
        assert np.abs(c * z.T @ (p - y) + np.append(beta[:3], 0)).max() < 1e-6 and fit.rounds < 30
        got = df.select("a", "b", "c", fit.probability().alias("p")).toPandas()
        t = got[["a", "b", "c"]].to_numpy() @ beta[:3] + beta[3]
        assert np.allclose(got["p"], 1 / (1 + np.exp(-t)))
    apart = spark.createDataFrame(pd.DataFrame({"a": np.r_[np.zeros(20), np.ones(20)], "y": np.r_[np.zeros(20, int), np.ones(20, int)]}))
    assert L.fitted(apart, ["a"], "y").weights[0] > 2
    one = L.fitted(df.withColumn("y", F.lit(1)), ["a"], "y")
    assert one.weights == (0.0,) and df.select(one.probability().alias("p")).distinct().collect()[0]["p"] == 1.0
    none = L.fitted(df.withColumn("y", F.lit(0)), ["a"], "y")
    assert df.select(none.probability().alias("p")).distinct().collect()[0]["p"] == 0.0
    holes = df.withColumn("a", F.when(F.col("b") > 35, F.lit(None)).otherwise(F.col("a")))
    assert L.fitted(holes, ["a", "b"], "y") == L.fitted(holes.filter("a IS NOT NULL"), ["a", "b"], "y")
