"""Queries without SQL on detectors, segments, forests, bootstraps and windows, against plain loops over the same tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.operators import models as M
from panelforge.operators import signal as G
from panelforge.plans import catalog

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def series(folder, by):
    li = pd.read_parquet(f"{folder}/lineitem.parquet", columns=["l_returnflag", "l_shipdate", "l_quantity"])
    daily = li.groupby(["l_returnflag", li["l_shipdate"].dt.date])["l_quantity"].sum().reset_index()
    daily.columns = ["unit", "day", "v"]
    if by == "month":
        daily["month"] = [d.replace(day=1) for d in daily["day"]]
        return daily.groupby(["unit", "month"])["v"].mean().reset_index()
    return daily


def test_cusum(spark):
    want = set()
    for unit, g in series(SMALL, "day").groupby("unit"):
        x = g.sort_values("day")["v"].to_numpy(float)
        z = (x - x.mean()) / x.std()
        up = down = 0.0
        last = None
        for i, v in enumerate(z):
            up, down = max(0.0, up + v - 0.5), max(0.0, down - v - 0.5)
            if (up > 5 or down > 5) and (last is None or i - last >= 10):
                want.add((unit, sorted(g["day"])[i]))
                up = down = 0.0
                last = i
    assert {tuple(r) for r in catalog.QUERIES["q202_cusum"](spark, SMALL).collect()} == want and want


def cost(x, a, b, gram):
    return (b - a) - gram[a:b, a:b].sum() / (b - a)


def best_split(x, penalty, least=2):
    """Exact segmentation, every split tried."""
    d = (x[:, None] - x[None]) ** 2
    gram = np.exp(-d / (np.median(d[d > 0]) if (d > 0).any() else 1.0))
    best, back = {0: -penalty}, {}
    for end in range(1, len(x) + 1):
        tried = [(best[a] + cost(x, a, end, gram) + penalty, a) for a in best if end - a >= least]
        if tried:
            best[end], back[end] = min(tried)
    out, at = [], len(x)
    while back[at]:
        at = back[at]
        out.append(at)
    return sorted(out)


def test_segments(spark):
    rng = np.random.default_rng(4)
    for _ in range(8):
        x = np.concatenate([rng.normal(m, 0.3, 12) for m in rng.choice([0, 2, 5], 3)])
        assert M.segments(x, 0.7) == best_split(x, 0.7)
    want = set()
    for unit, g in series(SMALL, "month").groupby("unit"):
        g = g.sort_values("month").reset_index(drop=True)
        want |= {(unit, g["month"][i]) for i in best_split(g["v"].to_numpy(float), 0.5)}
    assert {tuple(r) for r in catalog.QUERIES["q266_segments"](spark, SMALL).collect()} == want and want


def test_change_report(spark):
    got = catalog.QUERIES["q267_change_report"](spark, SMALL).collect()
    monthly, daily = series(SMALL, "month"), series(SMALL, "day")
    daily["month"] = [d.replace(day=1) for d in daily["day"]]
    days = daily.groupby(["unit", "month"])["v"].count().reset_index()
    want = {}
    for name, table in (("mean", monthly), ("days", days)):
        for unit, g in table.groupby("unit"):
            g = g.sort_values("month").reset_index(drop=True)
            x = g["v"].to_numpy(float)
            for method, at in (("segments", best_split(x, 0.5)), ("cusum", M.cusum(x, 0.5, 5.0, 7))):
                want[unit, name, method] = [g["month"][i] for i in at]
    assert {(r["unit"], r["series"], r["method"]): (r["n"], r["months"], r["in_window"]) for r in got} == {k: (len(v), ",".join(map(str, v)), any(dt.date(1997, 6, 1) <= m <= dt.date(1997, 12, 31) for m in v)) for k, v in want.items()}


def test_forest(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 2)), [[9.0, 9.0], [-8.0, 7.0]]])
    s = M.isolation_scores(x, x, 200, 128, 7)
    assert set(np.argsort(s)[-2:]) == {300, 301} and s[300] > 0.7 and np.median(s) < 0.5
    orders = pd.read_parquet(f"{SMALL}/orders.parquet", columns=["o_orderdate", "o_totalprice"])
    daily = orders.groupby(orders["o_orderdate"].dt.date)["o_totalprice"].agg(["mean", "count"])
    daily["year"] = [d.year for d in daily.index]
    want = {}
    for _, g in daily.groupby("year"):
        points = g[["mean", "count"]].to_numpy(float)
        scores = M.isolation_scores(points, points, 200, 128, 7)
        want |= {d: (round(float(v), 6), bool(v > np.percentile(scores, 99))) for d, v in zip(g.index, scores, strict=True)}
    got = {r["day"]: (r["score"], r["anomaly"]) for r in catalog.QUERIES["q265_isolation_forest"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(abs(got[d][0] - want[d][0]) < 2e-6 and got[d][1] == want[d][1] for d in want)


def test_group_bootstrap(spark):
    orders = pd.read_parquet(f"{SMALL}/orders.parquet", columns=["o_custkey", "o_totalprice"])
    sums = orders.groupby("o_custkey")["o_totalprice"].agg(["sum", "count"])
    wide = np.dtype(orders["o_custkey"].dtype).itemsize
    steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])

    def weight(key, r):
        h = 42
        for n, size in ((key, wide), (r, 4), (5, 4)):
            h = xxhash.xxh64_intdigest(int(n).to_bytes(size, "little", signed=True), h)
        return int((steps <= (h % (1 << 40)) / (1 << 40)).sum())

    means = []
    for r in range(200):
        w = np.array([weight(k, r) for k in sums.index])
        means.append((w * sums["sum"]).sum() / (w * sums["count"]).sum())
    got = catalog.QUERIES["q270_group_bootstrap"](spark, SMALL).first()
    assert [got["low"], got["median"], got["high"]] == pytest.approx(np.percentile(means, [2.5, 50, 97.5]), abs=2e-3)


def test_window_features(spark):
    events = pd.read_parquet(f"{LARGER}/events.parquet", columns=["ts", "value"])
    hourly = events.groupby(events["ts"].dt.floor("h"))["value"].mean()
    want = {}
    for day, g in hourly.groupby(hourly.index.floor("D")):
        if len(g) == 24:
            y = g.to_numpy() - g.mean()
            spectrum = np.abs(np.fft.rfft(y * np.hanning(24))) ** 2
            share, freq = spectrum / spectrum.sum(), np.fft.rfftfreq(24, 1 / 24)
            want[day.to_pydatetime()] = (np.sqrt((y**2).mean()), np.abs(y).max(), (np.diff(np.sign(y) < 0) != 0).mean(), (freq * share).sum(), freq[share.argmax()])
    got = {r["start"]: (r["rms"], r["peak"], r["zero_rate"], r["centroid_hz"], r["dominant_hz"]) for r in catalog.QUERIES["q306_window_features"](spark, LARGER).collect()}
    assert set(got) == set(want) and len(want) > 5 and all(np.allclose(got[d], want[d], atol=1e-6) for d in want)


def test_coherence(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 400)
    rows = [(1, a.tolist(), (a * 3 + 1).tolist()), (2, a.tolist(), rng.normal(0, 1, 400).tolist()), (3, [0.0] * 400, a.tolist()), (4, [1.0], [2.0])]
    got = {r["k"]: r for r in G.coherent(spark.createDataFrame(rows, "k long, a array<double>, b array<double>"), ["k"], "a", "b", 42.0).collect()}
    assert min(got[1]["low"], got[1]["mid"], got[1]["high"]) > 0.999 and max(got[2]["mid"], got[2]["high"]) < 0.5
    assert [got[k][c] for k in (3, 4) for c in ("low", "mid", "high")] == [0.0] * 6


def test_covariances_in_full(spark):
    c = spark.createDataFrame([("p", 2, 4.0, 1.0, 2.0), ("q", 6, 8.0, -3.0, 6.0)], "k string, n long, aa double, ab double, bb double")
    got = {(r["family"], r["component"], r["i"], r["j"]): r["value"] for r in M.full_covariances(c, "k", "n", [["aa", "ab"], ["ab", "bb"]]).collect()}
    assert got["tied", "p", 0, 0] == got["tied", "q", 0, 0] == 7.0 and got["tied", "p", 0, 1] == -2.0 and got["full", "q", 1, 0] == -3.0
    assert got["diag", "q", 0, 1] == 0.0 and got["diag", "q", 1, 1] == 6.0 and got["spherical", "p", 0, 0] == got["spherical", "p", 1, 1] == 3.0 and len(got) == 32


def test_mixtures_sweep_reports_the_mode(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 0.5, (150, 2)) for m in (0, 5)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1]}))
    got = M.mixture_sweep(df, "id", ["a", "b"], [1, 2, 3], [1, 2, 3]).collect()
    for s in (1, 2, 3):
        mine = [r for r in got if r["seed"] == s and r["converged"]]
        assert [r["k"] for r in mine if r["chosen"]] == [min(mine, key=lambda r: r["bic"])["k"]]
    assert {r["k"] for r in got if r["modal"]} == {2}
    one = [r for r in got if r["k"] == 1][0]
    like = -sum(np.log(2 * np.pi * (x[:, j].var() + 1e-6)) / 2 * 300 + ((x[:, j] - x[:, j].mean()) ** 2).sum() / (2 * (x[:, j].var() + 1e-6)) for j in (0, 1))
    assert one["bic"] == pytest.approx(4 * np.log(300) - 2 * like, rel=1e-6)


def test_coherence_query(spark):
    """Against segments written out: three half-overlapping ones of 13 weeks."""
    daily = series(SMALL, "day")
    daily["week"] = [(d - dt.date(1970, 1, 5)).days // 7 for d in daily["day"]]
    weekly = daily.groupby(["unit", "week"])["v"].sum().reset_index()
    windows = {}
    for (unit, half), g in weekly.groupby([weekly["unit"], weekly["week"] // 26]):
        if len(g) == 26:
            windows[unit, half] = g.sort_values("week")["v"].to_numpy(float)
    want = {}
    for (a, half), x in windows.items():
        for (b, other), y in windows.items():
            if half == other and a < b:
                cut = lambda v: [np.fft.rfft((s - s.mean()) * np.hanning(13)) for s in (v[0:13], v[6:19], v[13:26])]
                fa, fb = cut(x), cut(y)
                cross = np.mean([p * q.conj() for p, q in zip(fa, fb, strict=True)], axis=0)
                msc = np.abs(cross) ** 2 / (np.mean(np.abs(fa) ** 2, axis=0) * np.mean(np.abs(fb) ** 2, axis=0))
                freq = np.fft.rfftfreq(13, 1 / 20)
                want[a, b, dt.date(1970, 1, 5) + dt.timedelta(days=int(half) * 182)] = [msc[(freq >= lo) & (freq < hi)].mean() for lo, hi in G.BANDS]
    got = {(r["a"], r["b"], r["start"]): [r["low"], r["mid"], r["high"]] for r in catalog.QUERIES["q307_coherence"](spark, SMALL).collect()}
    assert set(got) == set(want) and len(want) > 5 and all(np.allclose(got[k], v, atol=1e-7) for k, v in want.items())
