"""Operators on planted data: known answers, gaps, ties, empty input."""

import numpy as np
from pyspark.sql import functions as F

from panelforge.functions import scalars, stats
from panelforge.operators import events, grids, models, windows


def test_rolling_never_spans_a_gap(spark):
    days = [f"2020-01-{d:02d}" for d in (1, 2, 3, 5, 6, 7, 8)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    got = [r["rolled"] for r in windows.rolling(df, ["k"], "d", "v", 3).orderBy("d").collect()]
    assert got == [None, None, 3.0, None, None, 12.0, 15.0]


def test_spells_and_empty(spark):
    df = spark.createDataFrame([("a", f"2020-01-{d:02d}", d in (2, 3, 7)) for d in range(1, 9)], "k string, d string, wet boolean").withColumn("d", F.to_date("d"))
    assert sorted(r["length"] for r in windows.spells(df, ["k"], "d", F.col("wet")).collect()) == [1, 2]
    assert windows.spells(df.limit(0), ["k"], "d", F.col("wet")).count() == 0


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, at int, v string")
    got = {(r["k"], r["t"]): r["matched_v"] for r in windows.as_of(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([("k", 0, 100), ("k", 250, 260)], "k string, s long, e long")
    b = spark.createDataFrame([("k", 90, 251), ("k", 100, 250)], "k string, s2 long, e2 long")
    got = sorted((r["s"], r["s2"]) for r in events.overlaps(a, b, ["k"], ("s", "e"), ("s2", "e2"), 50).collect())
    assert got == [(0, 90), (250, 90)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in events.components(edges, "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[101] == 100


def test_slope_of_a_tilted_plane(spark):
    plane = spark.createDataFrame([(r, c, 3.0 * c) for r in range(5) for c in range(5)], "row int, col int, v double")
    got = {(r["row"], r["col"]): r for r in grids.slope_aspect(plane, "v", 1.0, 1.0).collect()}
    assert abs(got[(2, 2)]["slope"] - np.degrees(np.arctan(3.0))) < 1e-9 and abs(got[(2, 2)]["aspect"] - 270.0) < 1e-9
    assert got[(0, 0)]["slope"] is None


def test_geometric_mean_skips_what_is_not_positive(spark):
    df = spark.createDataFrame([(2.0, 8.0, -1.0), (None, 0.0, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(scalars.geometric_mean(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert abs(got[0] - 4.0) < 1e-12 and got[1] is None


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.1)], "k string, y int, s double")
    got = {r["k"]: r["auc"] for r in stats.auc(df, ["k"], "y", "s").collect()}
    assert got == {"a": 0.75, "b": None}


def test_mixture_finds_planted_centres():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (200, 2)) for c in (0, 5, 10)])
    for family in ("full", "tied", "diag", "spherical"):
        best = max((models.mixture(x, 3, family, s) for s in range(4)), key=lambda m: m[2])
        assert np.allclose(sorted(best[1][:, 0]), [0, 5, 10], atol=0.2)


def test_segments_find_the_step():
    x = np.concatenate([np.zeros(30), np.full(30, 8.0)]) + np.random.default_rng(1).normal(0, 0.5, 60)
    assert models.segments(x, 2.0) == [30]


def test_cusum_fires_after_a_shift():
    x = np.concatenate([np.zeros(50), np.full(50, 3.0)])
    assert models.cusum(x, 0.5, 4.0, 10) and models.cusum(np.zeros(10), 0.5, 4.0, 10) == []


def test_forest_ranks_the_outlier_first():
    x = np.random.default_rng(2).normal(0, 1, (300, 2))
    x[17] = [9, 9]
    assert int(np.argmax(models.isolation_scores(x, x, 60, 128, 3))) == 17
