"""Queries on polygon layers, rasters, terrain and warped grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import polygons as P
from panelforge.operators import terrain as T
from panelforge.plans.grids import GRID_SQL, grid
from panelforge.plans.registry import Tables, query

#: Suppliers as five-cornered lots with a notch and a hole, all on quarters; customers as points.
SHAPE = [[(-1, -1), (1, -1), (1, 1), (0, 0.5), (-1, 1)], [(-0.25, -0.5), (-0.25, 0), (0.25, 0), (0.25, -0.5)]]
_CORNERS = ", ".join(f"({r}, {i}, {a}::DOUBLE, {b}::DOUBLE, {ring[(i + 1) % len(ring)][0]}::DOUBLE, {ring[(i + 1) % len(ring)][1]}::DOUBLE)" for r, ring in enumerate(SHAPE) for i, (a, b) in enumerate(ring))
LOTS_SQL = f"""s AS (SELECT s_suppkey AS id, (s_suppkey * 37) % 200::DOUBLE AS cx, (s_suppkey * 61) % 200::DOUBLE AS cy, 4 + 4 * (s_suppkey % 2)::DOUBLE AS r FROM supplier),
    e AS (SELECT id, cx + r * a AS x1, cy + r * b AS y1, cx + r * c AS x2, cy + r * d AS y2 FROM s, (VALUES {_CORNERS}) v(ring, i, a, b, c, d))"""
POINTS_SQL = "p AS (SELECT c_custkey AS point, (c_custkey * 13) % 200 + (c_custkey % 4) / 4.0::DOUBLE AS x, (c_custkey * 29) % 200 + (c_custkey % 8 // 2) / 4.0::DOUBLE AS y FROM customer)"
HIT_SQL = """h AS (SELECT point, id, bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_it,
    count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END + x1) % 2 = 1 AS odd FROM p, e GROUP BY 1, 2)"""


def lots(t: Tables) -> DataFrame:
    cx, cy = ((F.col("s_suppkey") * k) % 200 for k in (37, 61))
    r = 4 + 4 * (F.col("s_suppkey") % 2)
    ring = lambda corners: F.array(*[F.struct((cx + r * a).cast("double").alias("x"), (cy + r * b).cast("double").alias("y")) for a, b in corners])
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.array(*map(ring, SHAPE)).alias("rings"))


def people(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("point"), ((k * 13) % 200 + (k % 4) / 4).alias("x"), ((k * 29) % 200 + F.floor((k % 8) / 2) / 4).alias("y"))


@query("q18_polygon_layer", f"WITH {LOTS_SQL} SELECT id, 'VALID_POLYGON' AS status, 2 AS n_rings, count(*)::INT AS n_points, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM e GROUP BY 1")
def polygon_layer(t: Tables) -> DataFrame:
    layer = lots(t)
    return P.checked(layer).join(P.areas(layer), "id").join(P.boxes(layer), "id").withColumn("area", F.round("area", 6))


@query("q401_territory_classes", f"""WITH {LOTS_SQL}, {POINTS_SQL}, {HIT_SQL}, c AS (SELECT point, id, CASE WHEN on_it THEN 'boundary' ELSE 'inside' END AS class FROM h WHERE on_it OR odd)
    SELECT p.point, c.id, coalesce(class, 'none') AS class FROM p LEFT JOIN c USING (point)""")
def territory(t: Tables) -> DataFrame:
    return P.located(people(t), lots(t), 8.0)


@query("q22_clipped_layer", f"""WITH {LOTS_SQL}, k AS (SELECT id, x1, y1, x2, y2, least(greatest(x1, 50), 130) AS a, least(greatest(x2, 50), 130) AS b FROM e),
    m AS (SELECT id, a, b, y1 + (a - x1) * (y2 - y1) / (x2 - x1) AS ya, y1 + (b - x1) * (y2 - y1) / (x2 - x1) AS yb FROM k WHERE x1 <> x2 AND a <> b),
    c AS (SELECT *, CASE WHEN ya = yb THEN [] ELSE list_filter([(40 - ya) / (yb - ya), (120 - ya) / (yb - ya)], lambda s: s > 0 AND s < 1) END AS cut FROM m),
    q AS (SELECT id, a, b, ya, yb, list_sort(list_concat([0.0, 1.0], cut)) AS s FROM c),
    u AS (SELECT id, a + (b - a) * s[i] AS xa, a + (b - a) * s[i + 1] AS xb, least(greatest(ya + (yb - ya) * s[i], 40), 120) AS va, least(greatest(ya + (yb - ya) * s[i + 1], 40), 120) AS vb FROM (SELECT *, unnest(range(1, len(s))) AS i FROM q)),
    z AS (SELECT id, abs(sum((xb - xa) * ((va + vb) / 2 - 40))) AS area FROM u GROUP BY 1) SELECT id, round(area, 6) AS area FROM z WHERE round(area, 6) > 0""")
def clipped_layer(t: Tables) -> DataFrame:
    cut = P.areas(P.clipped(lots(t), 50.0, 40.0, 130.0, 120.0)).withColumn("area", F.round("area", 6))
    return cut.filter("area > 0")


@query("q23_raster", f"""WITH {LOTS_SQL}, g AS (SELECT r.range AS row, c.range AS col, 10 + (c.range + 0.5) * 1.5 AS x, 20 + (r.range + 0.5) * 1.5 AS y FROM range(100) r, range(120) c), p AS (SELECT row * 1000 + col AS point, x, y FROM g), {HIT_SQL}
    SELECT point // 1000 AS row, point % 1000 AS col, count(*) AS n FROM h WHERE odd GROUP BY 1, 2""")
def raster(t: Tables) -> DataFrame:
    return P.covered(lots(t), 10.0, 20.0, 1.5, 1.5, 100, 120).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("q17_meeting_polygons", f"""WITH {LOTS_SQL}, b AS (SELECT id, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM e GROUP BY 1),
    m AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND a.bx0 <= b.bx1 AND b.bx0 <= a.bx1 AND a.by0 <= b.by1 AND b.by0 <= a.by1),
    t AS (SELECT DISTINCT a, b FROM m JOIN e p ON p.id = a JOIN e q ON q.id = b WHERE least(p.x1, p.x2) <= greatest(q.x1, q.x2) AND least(q.x1, q.x2) <= greatest(p.x1, p.x2) AND least(p.y1, p.y2) <= greatest(q.y1, q.y2) AND least(q.y1, q.y2) <= greatest(p.y1, p.y2)
        AND sign((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * sign((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) <= 0 AND sign((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * sign((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) <= 0),
    p AS (SELECT id AS point, cx - r AS x, cy - r AS y FROM s), {HIT_SQL} SELECT a, b FROM t UNION SELECT least(point, id), greatest(point, id) FROM h WHERE (on_it OR odd) AND point <> id""")
def meeting_polygons(t: Tables) -> DataFrame:
    return P.meeting(lots(t), 8.0)


#: The grid of parts with one cell in eleven missing.
HOLED_SQL = GRID_SQL.replace("FROM part", "FROM part WHERE p_partkey % 11 <> 5")
NEAR_SQL = f"""{HOLED_SQL}, m AS (SELECT avg(v) AS fill, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g),
    n AS (SELECT a.row, a.col, b.row - a.row AS dr, b.col - a.col AS dc, b.v FROM g a JOIN g b ON abs(a.row - b.row) <= 4 AND abs(a.col - b.col) <= 4),
    x AS (SELECT row, col, max(v) - min(v) AS relief, stddev_pop(v) FILTER (abs(dr) <= 1 AND abs(dc) <= 1) AS roughness,
        {", ".join(f"max(v) FILTER (dr = {r} AND dc = {c}) AS v{r + 1}{c + 1}" for r in (-1, 0, 1) for c in (-1, 0, 1))} FROM n GROUP BY 1, 2),
    d AS (SELECT x.*, coalesce((v02 + 2 * v12 + v22 - v00 - 2 * v10 - v20) / 80, (CASE WHEN col = c1 THEN v11 ELSE coalesce(v12, fill) END - CASE WHEN col = c0 THEN v11 ELSE coalesce(v10, fill) END) / (CASE WHEN col IN (c0, c1) THEN 10 ELSE 20 END)) AS east,
        coalesce((v00 + 2 * v01 + v02 - v20 - 2 * v21 - v22) / 80, (CASE WHEN row = r0 THEN v11 ELSE coalesce(v01, fill) END - CASE WHEN row = r1 THEN v11 ELSE coalesce(v21, fill) END) / (CASE WHEN row IN (r0, r1) THEN 10 ELSE 20 END)) AS north FROM x, m)"""


def holed(t: Tables) -> DataFrame:
    return grid(t).filter("id % 11 <> 5")


@query("q403_terrain_components", f"""WITH {NEAR_SQL} SELECT row, col, unnest(['slope', 'local_relief', 'roughness']) AS component, unnest([round(degrees(atan(sqrt(east * east + north * north))), 5), round(relief, 6), round(roughness, 6)]) AS value FROM d""")
def components(t: Tables) -> DataFrame:
    """The terrain components of every cell in long form."""
    layers = T.terrain_layers(holed(t), "v", 10.0, 10.0, tile=16)
    rounded = layers.select("row", "col", F.round("slope", 5).alias("slope"), F.round("relief", 6).alias("local_relief"), F.round("roughness", 6).alias("roughness"))
    return T.long_form(rounded, ["row", "col"], ["slope", "local_relief", "roughness"])


@query("q489_gradient_with_edges", f"WITH {NEAR_SQL} SELECT row, col, round(degrees(atan(abs(east))), 5) AS slope FROM d WHERE row = 0 OR col IN (0, 39) OR v00 IS NULL OR v22 IS NULL")
def edge_gradients(t: Tables) -> DataFrame:
    """Cells that lack a corner neighbour or lie on the first row or outer columns: the slope from west to east there."""
    layers = T.terrain_layers(holed(t), "v", 10.0, 10.0, tile=16)
    have = holed(t).select("row", "col")
    corner = lambda s: have.select((F.col("row") + s).alias("row"), (F.col("col") + s).alias("col"), F.lit(True).alias(f"c{s + 1}"))
    lacking = layers.join(corner(1), ["row", "col"], "left").join(corner(-1), ["row", "col"], "left").filter("row = 0 OR col IN (0, 39) OR c2 IS NULL OR c0 IS NULL")
    along = F.tan(F.radians("slope")) * F.abs(F.sin(F.radians("aspect")))
    return lacking.select("row", "col", F.round(F.degrees(F.atan(F.when(F.col("aspect") == T.FLAT, 0.0).otherwise(along))), 5).alias("slope"))


@query("q85_aspect", f"WITH {NEAR_SQL} SELECT row, col, CASE WHEN east = 0 AND north = 0 THEN -9999.0 ELSE round(((degrees(atan2(-east, -north)) % 360) + 360) % 360, 4) % 360 END AS aspect FROM d")
def aspect(t: Tables) -> DataFrame:
    layers = T.terrain_layers(holed(t), "v", 10.0, 10.0, tile=16)
    return layers.select("row", "col", F.when(F.col("aspect") == T.FLAT, F.col("aspect")).otherwise(F.round("aspect", 4) % 360).alias("aspect"))


@query("q21_warped_grid", f"""WITH {HOLED_SQL}, x AS (SELECT max(row) AS last FROM g), k AS (SELECT r.range AS row, c.range AS col FROM range((SELECT last + 3 FROM x)) r, range(30) c),
    w AS (SELECT row, col, 0.8 * row + 0.15 * col - 1.3 AS y, 1.25 * col - 0.1 * row + 0.4 AS x FROM k),
    s AS (SELECT w.row, w.col, (1 - abs(y - g.row)) * (1 - abs(x - g.col)) AS weight, v FROM w LEFT JOIN g ON g.row BETWEEN floor(y) AND floor(y) + 1 AND g.col BETWEEN floor(x) AND floor(x) + 1)
    SELECT row, col, round(sum(weight * v) FILTER (weight > 1e-12) / sum(weight) FILTER (weight > 1e-12), 6) AS value FROM s GROUP BY 1, 2""")
def warped_grid(t: Tables) -> DataFrame:
    """The grid of parts on a turned and stretched one of 30 columns, as many rows as the parts need."""
    source = holed(t)
    rows = source.agg((F.max("row") + 3).alias("n"))
    target = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row")).select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("col"))
    w = T.warped(source, "v", target, lambda r, c: (0.8 * r + 0.15 * c - 1.3, 1.25 * c - 0.1 * r + 0.4))
    return w.select("row", "col", F.round("value", 6).alias("value"))
