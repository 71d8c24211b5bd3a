"""Polygons, rasters, terrain and warps against plain readings of their definitions."""

import math
import random

import numpy as np
import pytest

from panelforge.operators import polygons as P
from panelforge.operators import terrain as T


def star(dice, cx, cy, r, n, hole=False):
    ring = [(cx + r * dice.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * dice.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    small = [(cx + 0.2 * r * math.cos(2 * math.pi * i / 4), cy - 0.2 * r * math.sin(2 * math.pi * i / 4)) for i in range(4)]
    return [ring, small] if hole else [ring]


@pytest.fixture(scope="module")
def shapes():
    dice = random.Random(8)
    out = {i: star(dice, dice.uniform(-20, 20), dice.uniform(-20, 20), dice.uniform(1, 9), dice.choice([3, 5, 9, 40]), i % 3 == 0) for i in range(25)}
    out[100] = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 8), (8, 8), (8, 2)], [(4, 4), (6, 4), (6, 6), (4, 6)]]  # closed, a hole, a part in the hole
    out[101] = [[(-30, -30), (30, -30), (30, 30), (-30, 30)]]
    out[102] = [[(40, 40), (41, 40), (41, 41)]]
    return out


@pytest.fixture(scope="module")
def layer(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in v]) for k, v in shapes.items()], f"id long, rings {P.RINGS}").repartition(3)


def pairs(rings):
    return [(ring[i], ring[(i + 1) % len(ring)]) for ring in rings for i in range(len(ring)) if ring[i] != ring[(i + 1) % len(ring)]]


def place(rings, x, y):
    odd = False
    for (x1, y1), (x2, y2) in pairs(rings):
        if (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return "boundary"
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return "inside" if odd else "none"


@pytest.mark.parametrize("tile", [1.5, 7.0, 500.0])
def test_points(spark, shapes, layer, tile):
    dice = random.Random(9)
    points = [(i, dice.uniform(-35, 35), dice.uniform(-35, 35)) for i in range(150)] + [(200, 0.0, 5.0), (201, 5.0, 2.0), (202, 5.0, 5.0), (203, 3.0, 3.0), (204, 10.0, 10.0), (205, -30.0, 0.0), (206, 90.0, 0.0), (207, 40.5, 40.0), (208, None, 1.0)]
    want = set()
    for i, x, y in points:
        hit = [(i, k, c) for k, rings in shapes.items() if x is not None and (c := place(rings, x, y)) != "none"]
        want |= set(hit or [(i, None, "none")])
    assert set(map(tuple, P.located(spark.createDataFrame(points, "point long, x double, y double"), layer, tile).collect())) == want


def crossing(p, q):
    (a, b), (c, d) = p, q
    side = lambda o, u, w: np.sign((u[0] - o[0]) * (w[1] - o[1]) - (u[1] - o[1]) * (w[0] - o[0]))
    over = all(min(a[i], b[i]) <= max(c[i], d[i]) and min(c[i], d[i]) <= max(a[i], b[i]) for i in (0, 1))
    return over and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def test_meeting_polygons(shapes, layer):
    want = set()
    for a in shapes:
        for b in shapes:
            if a < b and (any(crossing(p, q) for p in pairs(shapes[a]) for q in pairs(shapes[b])) or place(shapes[b], *shapes[a][0][0]) != "none" or place(shapes[a], *shapes[b][0][0]) != "none"):
                want.add((a, b))
    for tile in (3.0, 40.0):
        assert set(map(tuple, P.meeting(layer, tile).collect())) == want


def test_raster_areas_and_clip(shapes, layer):
    got = {tuple(r) for r in P.covered(layer, -25.0, -25.0, 0.75, 1.25, 40, 50).collect()}
    want = {(r, c, k) for k, rings in shapes.items() for r in range(40) for c in range(50) if place(rings, -25 + (c + 0.5) * 0.75, -25 + (r + 0.5) * 1.25) == "inside"}
    assert {(r, c, k) for r, c, k in got ^ want if place(shapes[k], -25 + (c + 0.5) * 0.75, -25 + (r + 0.5) * 1.25) != "boundary"} == set()
    area = {r["id"]: r["area"] for r in P.areas(layer).collect()}
    assert area[100] == pytest.approx(100 - 36 + 4) and area[101] == 3600
    cut = {r["id"]: r["area"] for r in P.areas(P.clipped(layer, -5.0, -5.0, 5.0, 7.0)).collect()}
    assert cut[101] == pytest.approx(120) and cut[100] == pytest.approx(5 * 7 - 3 * 5 + 1 * 2) and 102 not in cut
    step = 0.05
    for k, rings in shapes.items():
        n = sum(place(rings, -5 + (i + 0.5) * step, -5 + (j + 0.5) * step) == "inside" for i in range(200) for j in range(240)) if k % 6 == 0 and k < 100 else None
        assert n is None or cut.get(k, 0.0) == pytest.approx(n * step * step, abs=0.35)


def test_what_is_left_out(spark):
    p = lambda *c: [{"x": x, "y": y} for x, y in c]
    rows = [(1, None), (2, []), (3, [[]]), (4, [p((0.0, 0.0), (1.0, 0.0))]), (5, [p((0.0, 0.0), (1.0, math.nan), (1.0, 1.0))]), (6, [p((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))])]
    odd = spark.createDataFrame(rows, f"id long, rings {P.RINGS}")
    assert {r["id"]: r["status"] for r in P.checked(odd).collect()} == {1: "EXCLUDED_NULL_GEOMETRY", 2: "EXCLUDED_EMPTY_GEOMETRY", 3: "EXCLUDED_EMPTY_GEOMETRY", 4: "EXCLUDED_INVALID_GEOMETRY", 5: "EXCLUDED_NON_FINITE", 6: "VALID_POLYGON"}
    assert P.located(spark.createDataFrame([(1, 0.2, 0.2)], "point long, x double, y double"), odd.limit(0), 1.0).collect()[0]["class"] == "none"


def terrain(z, dx, dy):
    rows, cols = z.shape
    fill = np.nanmean(z)
    full = np.where(np.isnan(z), fill, z)
    at = lambda r, c: z[r, c] if 0 <= r < rows and 0 <= c < cols else np.nan
    gy, gx = np.gradient(full, dy, dx)
    out = {}
    for r in range(rows):
        for c in range(cols):
            if np.isnan(z[r, c]):
                continue
            e = sum(w * (at(r + k, c + 1) - at(r + k, c - 1)) for k, w in ((-1, 1), (0, 2), (1, 1))) / (8 * dx)
            n = sum(w * (at(r - 1, c + k) - at(r + 1, c + k)) for k, w in ((-1, 1), (0, 2), (1, 1))) / (8 * dy)
            e, n = gx[r, c] if np.isnan(e) else e, -gy[r, c] if np.isnan(n) else n
            near = [at(i, j) for i in range(r - 4, r + 5) for j in range(c - 4, c + 5)]
            three = [at(i, j) for i in range(r - 1, r + 2) for j in range(c - 1, c + 2)]
            out[r, c] = (math.degrees(math.atan(math.hypot(e, n))), math.degrees(math.atan2(-e, -n)) % 360 if e or n else T.FLAT, np.nanmax(near) - np.nanmin(near), np.nanstd(three))
    return out


@pytest.mark.parametrize("tile", [5, 64])
def test_terrain(spark, tile):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 5, (17, 23)) + np.arange(23)
    z[rng.random(z.shape) < 0.1] = np.nan
    z[3:8, 3:8] = 4.0
    rows = [(r + 100, c - 7, float(z[r, c]) if not np.isnan(z[r, c]) else None) for r in range(17) for c in range(23)]
    got = {(r["row"] - 100, r["col"] + 7): tuple(r)[2:] for r in T.terrain_layers(spark.createDataFrame(rows, "row long, col long, v double"), "v", 2.0, 3.0, tile=tile).collect()}
    want = terrain(z, 2.0, 3.0)
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-9), (k, got[k], v)
    east = {(0, c): 2.0 * c for c in range(6)} | {(r, c): 2.0 * c for r in range(6) for c in range(6)}
    plane = T.terrain_layers(spark.createDataFrame([(r, c, v) for (r, c), v in east.items()], "row long, col long, v double"), "v", 1.0, 1.0).filter("row = 2 AND col = 2").first()
    assert plane["slope"] == pytest.approx(math.degrees(math.atan(2))) and plane["aspect"] == 270.0 and plane["relief"] == 10.0


def test_warp(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, (20, 30))
    z[rng.random(z.shape) < 0.15] = np.nan
    source = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(20) for c in range(30)], "row long, col long, v double")
    target = spark.createDataFrame([(r, c) for r in range(15) for c in range(15)], "row long, col long")
    got = {(r["row"], r["col"]): r["value"] for r in T.warped(source, "v", target, lambda r, c: (1.3 * r - 0.2 * c + 0.5, 0.3 * r + 1.6 * c)).collect()}
    for (r, c), value in got.items():
        y, x = 1.3 * r - 0.2 * c + 0.5, 0.3 * r + 1.6 * c
        total = weight = 0.0
        for i in (math.floor(y), math.floor(y) + 1):
            for j in (math.floor(x), math.floor(x) + 1):
                w = (1 - abs(y - i)) * (1 - abs(x - j))
                if 0 <= i < 20 and 0 <= j < 30 and not np.isnan(z[i, j]) and w > 0:
                    total, weight = total + w * z[i, j], weight + w
        assert (value is None) == (weight == 0) and (value is None or abs(value - total / weight) < 1e-9)
    assert len(got) == 225 and T.warped(source, "v", target.limit(0), lambda r, c: (r, c)).count() == 0
