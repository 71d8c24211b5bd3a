"""Queries that take whole tables: every row counts, whatever its key."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import models
from panelforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table, key", [("q104_verified_binding_all", "orders", "o_orderkey"), ("q461_date_ranges_all", "orders", "o_orderkey"), ("q354_continuous_axis_all", "events", "user_id"), ("q237_event_groups_all", "orders", "o_custkey")])
def test_every_key_comes_out(spark, name, table, key):
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    want = rows.filter("o_orderkey % 4 > 0") if name == "q461_date_ranges_all" else rows  # the other ranges end before they start
    got = catalog.QUERIES[name](spark, FOLDER)
    seen = got.select(F.col("node" if "node" in got.columns else key).alias(key)).distinct()
    assert want.select(key).distinct().join(seen, key, "left_anti").count() == 0


def test_zones_against_brute_force(spark, tmp_path):
    spark.range(1, 1301).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["node"]: r["zone"] for r in catalog.QUERIES["q312_distance_zones_all"](spark, str(tmp_path)).collect()}
    k = np.arange(1, 1301)
    x, y = (k * 7919 % 1000) / 10.0, (k * 104729 % 1000) / 10.0
    near = np.hypot(x[:, None] - x, y[:, None] - y) <= 5
    zone = k.copy()
    while True:
        new = np.where(near, zone[None], k.max() + 1).min(1)
        if (new == zone).all():
            break
        zone = new
    assert got == dict(zip(k.tolist(), zone.tolist(), strict=True))


def test_mixture_takes_every_row(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (1500, 2)) for c in (0, 20)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(3)
    got = {(r["k"], r["seed"]): r for r in models.mixture_sweep(df, "id", ["a", "b"], [1, 2], [11]).collect()}
    for k in (1, 2):
        _, _, like, ok = models.mixture(x, k, "diag", 11)
        free = 4 * k + k - 1
        assert ok and got[(k, 11)]["converged"] and abs(got[(k, 11)]["bic"] - (free * np.log(3000) - 2 * like)) < 1.0


def test_kmeans_and_silhouette_take_every_row_and_place(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.concatenate([np.zeros((250, 4)), rng.normal(c, 0.2, (250, 2))], axis=1) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {r["k"]: r for r in models.kmeans_sweep(df, "id", "v", [2, 3, 4], 1).collect()}
    for k in (2, 3):
        label, _, inertia = models.kmeans(x, k, 1)
        assert abs(got[k]["inertia"] - inertia) < 1e-6 * inertia and abs(got[k]["silhouette"] - models.silhouette(x, label)) < 1e-6
    assert max(got, key=lambda k: got[k]["silhouette"]) == 3


def test_silhouette_by_blocks(spark):
    x = np.random.default_rng(6).normal(0, 1, (300, 3))
    c = x[:4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>").repartition(2)
    label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert abs(models.silhouettes(df, {4: c}, block=70)[4] - models.silhouette(x, label)) < 1e-9


def test_sweeps_read_whole_tables(spark):
    plans = {n: catalog.QUERIES[n](spark, FOLDER).collect() for n in ("q242_mixture_sweep", "q272_kmeans_best_k", "q265_isolation_forest")}
    assert sorted(r["k"] for r in plans["q272_kmeans_best_k"]) == [2, 3, 4, 5, 6] and len(plans["q242_mixture_sweep"]) == 5 * 3
    flagged = [r for r in plans["q265_isolation_forest"] if r["anomaly"]]
    assert 0 < len(flagged) <= 0.02 * len(plans["q265_isolation_forest"])


def _weighed_silhouette(x, w, label):
    """models.silhouette over places of which there are w rows each."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    total = np.stack([d[:, label == g] @ w[label == g] for g in range(label.max() + 1)], axis=1)
    size, at = np.array([w[label == g].sum() for g in range(label.max() + 1)]), np.arange(len(x))
    a, other = total[at, label] / np.maximum(size[label] - 1, 1), total / size
    other[at, label] = np.inf
    b = other.min(1)
    return float((w * np.where(size[label] > 1, (b - a) / np.maximum(a, b), 0)).sum() / w.sum())


def test_silhouette_judges_every_row(spark):
    rng = np.random.default_rng(8)
    x, c = rng.normal(0, 2, (600, 2)), np.array([[-1.0, 0], [1.5, 0.5]])
    label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>").repartition(3)
    assert abs(models.silhouettes(df, {2: c}, block=100, judged=200)[2] - models.silhouette(x, label)) < 1e-9
    # more rows than were judged before, of few places
    w = 1 + np.bincount((300 * rng.random(39_700) ** 2).astype(int), minlength=300)
    places = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x[:300], w, strict=True))], "p long, x array<double>, n int")
    rows = places.selectExpr("x", "explode(sequence(1, n)) AS r", "p").selectExpr("p * 100000 + r AS key", "x").repartition(3)
    assert rows.count() == 40_000 and abs(models.silhouettes(rows, {2: c})[2] - _weighed_silhouette(x[:300], w, label[:300])) < 1e-9


def test_silhouette_of_many_places_copies_and_gaps(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 1, (60, 12)) + 1000 for m in (0, 1, 3)])
    x, c = np.concatenate([x, x[:50], x[:7]]), x[[0, 60, 120]]
    label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    made = [(i, v.tolist()) for i, v in enumerate(x)]
    df = lambda rows: spark.createDataFrame(rows, "key long, x array<double>").repartition(3)
    exact = models.silhouette(x, label)
    assert abs(models.silhouettes(df(made), {3: c}, block=50, judged=16)[3] - exact) < 1e-9
    gaps = [(900, None), (901, [None, *x[0][1:].tolist()])]
    assert abs(models.silhouettes(df(made + gaps), {3: c}, block=50)[3] - exact * len(x) / (len(x) + 2)) < 1e-9
    assert models.silhouettes(df(gaps), {3: c}) == {3: 0.0} and models.silhouettes(df([]), {3: c}) == {3: None}


def test_silhouette_of_odd_parts_as_in_sql(spark, tmp_path):
    # one part as far from two centres, copies of a place, a cluster of one, parts without a size or price
    made = [(26, 1271.25), (26, 1271.25), (40, 1228.0), (39, 1230.5), (25, 1836.0), (25, 1836.0), (24, 1800.0), (10, 1204.0), (None, 1200.0), (12, None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for kept in ("true", "p_size IS NULL", "false"):
        folder = tmp_path / kept.split()[0]
        spark.read.parquet(str(tmp_path / "part.parquet")).filter(kept).coalesce(1).write.parquet(str(folder / "part.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS FROM '{folder}/part.parquet/*.parquet'")
        assert [tuple(r) for r in catalog.QUERIES["q251_silhouette"](spark, str(folder)).collect()] == con.execute(catalog.ORACLES["q251_silhouette"]).fetchall()
