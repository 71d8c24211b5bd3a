"""Refits of weighted replicates against refitting each subset by itself, with rows written out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import refits as R


def written_out(x, start, k, rounds=500, tolerance=1e-3, floor=1e-6):
    """(shares, means, log-likelihood) of a full mixture of rows x, standardised, from the given centres."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    n, d = z.shape
    resp, before = np.eye(k)[((z[:, None] - start[None]) ** 2).sum(2).argmin(1)], -np.inf
    for _ in range(rounds):
        size = resp.sum(0) + 1e-10
        means = resp.T @ z / size[:, None]
        covs = [(resp[:, i, None] * z).T @ z / size[i] - np.outer(means[i], means[i]) + floor * np.eye(d) for i in range(k)]
        dens = np.stack([np.log(size[i] / size.sum()) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(covs[i])[1] + (((z - means[i]) @ np.linalg.inv(covs[i])) * (z - means[i])).sum(1)) for i in range(k)], axis=1)
        total = np.logaddexp.reduce(dens, axis=1)
        resp = np.exp(dens - total[:, None])
        if abs(total.sum() - before) < tolerance * n:
            break
        before = total.sum()
    return size / size.sum(), means, total.sum()


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    n = 240
    centre = np.array([[0, 0], [6, 1], [1, 7]])[rng.integers(0, 3, n)]
    x = centre + rng.normal(0, 0.7, (n, 2))
    day = pd.Timestamp("2020-06-01") + pd.to_timedelta(np.where(np.arange(n) // 2 < 40, np.arange(n) // 2, np.arange(n) // 2 + 11), "D")
    frame = pd.DataFrame({"id": np.arange(n), "grp": [f"g{i % 4}" for i in range(n)], "season": ["a", "b"], "f1": x[:, 0], "f2": x[:, 1], "day": day.date} | {"season": [("a", "b")[i % 2] for i in range(n)]})
    return frame, spark.createDataFrame(frame).repartition(3)


def test_weighted_fits_equal_fits_of_rows_written_out(spark, panel):
    frame, df = panel
    x = frame[["f1", "f2"]].to_numpy()
    numbered = df.withColumn("u", F.substring("grp", 2, 1).cast("long"))
    data = R.points(numbered, "id", ["u"], ["f1", "f2"])
    start = np.array([[-0.5, -0.5], [1.0, 0.0], [0.0, 1.0]])
    jobs = [(r, 3, 1) for r in range(4)]
    for weigh, rows in ((R.all_but, lambda r: x[np.arange(len(x)) % 4 != r]), (R.only, lambda r: x[np.arange(len(x)) % 4 == r])):
        for fit in R.refitted(data, 1, 2, jobs, weigh, starts=dict.fromkeys(jobs, start)):
            share, means, like = written_out(rows(fit.replicate), start, 3)
            assert fit.converged and np.allclose(fit.share, share, atol=1e-8) and np.allclose(fit.means, means, atol=1e-8) and np.isclose(fit.like, like)


def test_calendar_blocks_weigh_days(spark, panel):
    frame, df = panel
    x = frame[["f1", "f2"]].to_numpy()
    day = np.array([(d - pd.Timestamp("1970-01-01").date()).days for d in frame["day"]])
    weigh = R.Blocks(np.unique(day), 7, 11)
    for r in range(3):
        starts = weigh.starts(r)
        assert len(starts) == -(-len(np.unique(day)) // 7) and np.isin(starts, day).all()
        assert (weigh(day[:, None], r) == [sum(s <= d < s + 7 for s in starts) for d in day]).all()
    data = R.points(df.withColumn("u", F.datediff("day", F.lit("1970-01-01"))), "id", ["u"], ["f1", "f2"])
    start = np.array([[-0.5, -0.5], [1.0, 0.0], [0.0, 1.0]])
    fit = R.refitted(data, 1, 2, [(2, 3, 1)], weigh, starts={(2, 3, 1): start})[0]
    share, means, like = written_out(np.repeat(x, weigh(day[:, None], 2).astype(int), axis=0), start, 3)
    assert np.allclose(fit.share, share, atol=1e-8) and np.allclose(fit.means, means, atol=1e-8) and np.isclose(fit.like, like)
    got = {r["parameter"]: r for r in R.block_refits(df, "id", "day", ["f1", "f2"], [1, 2, 3, 4], [11, 12], 40, 7).collect()}
    assert all(r["succeeded"] + r["failures"] == 40 and r["status"] == "PASS" and r["low"] <= r["high"] for r in got.values())
    assert {k for k in got if k.startswith("weight")} == {"weight0", "weight1", "weight2"} and got["ari"]["low"] > 0.9


def test_folds_and_strata(spark, panel):
    frame, df = panel
    left = R.group_refits(df, "id", "grp", ["f1", "f2"], [1, 2, 3, 4], [11, 12], True).collect()
    assert [r["fold"] for r in left] == ["g0", "g1", "g2", "g3"] and all(r["status"] == "PASS" and r["n_fit"] == 180 and r["n_left_out"] == 60 and r["ari_left_out"] > 0.9 and r["js"] < 0.05 for r in left)
    axes = R.axis_refits(df.withColumn("few", F.when(F.col("id") < 20, "few").otherwise("many")), "id", ["season", "few"], ["f1", "f2"], [1, 2, 3, 4], [11, 12]).collect()
    assert {(r["axis"], r["stratum"]): r["status"] for r in axes} == {("season", "a"): "PASS", ("season", "b"): "PASS", ("few", "few"): "SKIPPED", ("few", "many"): "PASS"}
    shifted = df.withColumn("f1", F.when(F.col("season") == "b", F.col("f1") * 0).otherwise(F.col("f1"))).withColumn("f2", F.when(F.col("season") == "b", F.lit(0.0)).otherwise(F.col("f2")))
    odd = {r["fold"]: r for r in R.group_refits(shifted, "id", "season", ["f1", "f2"], [2, 3], [11], False).collect()}
    assert odd["b"]["status"] in ("FAIL", "NONCONVERGED") or odd["b"]["ari"] is not None


def test_statistics_of_tables():
    table = np.array([[5.0, 1], [2, 6]])
    pairs = [(i, j) for i, row in enumerate(table.astype(int)) for j, n in enumerate(row) for _ in range(n)]
    same = [(a == c, b == d) for x, (a, b) in enumerate(pairs) for c, d in pairs[:x]]
    n = len(same)
    both, one, two = sum(p and q for p, q in same), sum(p for p, _ in same), sum(q for _, q in same)
    assert np.isclose(R.agreement(table), (both - one * two / n) / ((one + two) / 2 - one * two / n))
    assert R.agreement(np.array([[4.0, 0], [0, 3]])) == 1.0 and R.divergence(np.array([1.0, 0]), np.array([0, 2.0])) == 1.0


def test_nulls_keep_margins_of_strata(spark, panel):
    frame, df = panel
    gap = df.withColumn("f2", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("f2")))
    null = R.matched_null(gap, "id", ["season"], ["f1", "f2"], 30, 3).toPandas()
    assert len(null) == 30 * len(frame) and null["f2"].notna().all()
    known = frame[frame["id"] % 7 != 0]
    for s in ("a", "b"):
        part, pool = null[null["season"] == s], known[known["season"] == s]["f2"]
        assert set(part["f2"]) <= set(pool) and abs(part["f2"].mean() - pool.mean()) < 5 * pool.std() / len(part) ** 0.5
        assert abs(part[["f1", "f2"]].corr().iloc[0, 1]) < 0.1
    again = R.matched_null(gap.repartition(5), "id", ["season"], ["f1", "f2"], 30, 3).toPandas()
    order = ["replicate", "id"]
    pd.testing.assert_frame_equal(null.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True))


def test_envelope_against_one_by_one(spark, panel):
    _, df = panel
    got = R.null_envelope(df, "id", ["season"], ["f1", "f2"], [1, 2, 3, 4], [11, 12], 20).first()
    assert got["k"] == 3 and got["observed"] > 0.6 and got["replicates"] == 20
    if got["failures"] == 0:
        assert got["null_min"] <= got["null_max"] and got["p"] in [i / 20 for i in range(21)] and (got["status"] == "PASS") == (got["p"] < 0.05)
    else:
        assert got["p"] is None and got["status"] == "FAIL"
    data = R.points(df, "id", [], ["f1", "f2"])
    ref = R.reference(data, 0, 2, [3], [11])
    z = ref.scaled(df.orderBy("id").select("f1", "f2").toPandas().to_numpy())
    label = ref.densities(z).argmax(1)
    far = np.sqrt(((z[:, None] - ref.means[None]) ** 2).sum(2))
    own = far[np.arange(len(z)), label]
    other = np.where(np.arange(3)[None] == label[:, None], np.inf, far).min(1)
    assert np.isclose(R.separations(data, 0, [ref], R.everything)[0], ((other - own) / np.maximum(own, other)).mean())
