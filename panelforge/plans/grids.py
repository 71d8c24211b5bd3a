"""Queries on grids and candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import cell_id
from panelforge.operators import grids as G
from panelforge.operators import order as O
from panelforge.plans.registry import Tables, query

#: Parts laid on a grid of 40 columns; the cell's value is the price.
GRID_SQL = "g AS (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, p_partkey AS id, p_retailprice AS v, CAST(p_size AS DOUBLE) AS size FROM part)"
NEAR_SQL = GRID_SQL + ", n AS (SELECT a.row, a.col, a.v, b.row - a.row AS r, b.col - a.col AS c, b.v AS w FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1)"


def grid(t: Tables) -> DataFrame:
    return t.part.select(F.expr("p_partkey div 40").alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("double").alias("size"))


@query("q84_slope_aspect", f"""WITH {NEAR_SQL}, d AS (SELECT row, col, CASE WHEN count(*) = 9 THEN (sum(w * c * (CASE WHEN r = 0 THEN 2 ELSE 1 END))) / 80.0 END AS e, CASE WHEN count(*) = 9 THEN sum(w * r * (CASE WHEN c = 0 THEN 2 ELSE 1 END)) / 80.0 END AS s FROM n GROUP BY 1, 2)
    SELECT row, col, round(degrees(atan(sqrt(e * e + s * s))), 5) AS slope FROM d""")
def slope(t: Tables) -> DataFrame:
    return G.slope_aspect(grid(t), "v", 10.0, 10.0).select("row", "col", F.round("slope", 5).alias("slope"))


@query("q86_curvature", f"""WITH {GRID_SQL} SELECT a.row, a.col, round((w.v - 2 * a.v + e.v) / 100.0 + (n.v - 2 * a.v + s.v) / 100.0, 6) + 0.0 AS curvature FROM g a LEFT JOIN g w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN g e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN g n ON n.col = a.col AND n.row = a.row - 1 LEFT JOIN g s ON s.col = a.col AND s.row = a.row + 1""")
def curvature(t: Tables) -> DataFrame:
    return G.curvature(grid(t), "v", 10.0, 10.0).select("row", "col", (F.round("curvature", 6) + 0.0).alias("curvature"))


@query("q310_relief_roughness", f"WITH {NEAR_SQL} SELECT row, col, CASE WHEN count(*) = 9 THEN round(max(w) - min(w), 6) END AS relief, CASE WHEN count(*) = 9 THEN round(stddev_pop(w), 6) END AS roughness FROM n GROUP BY 1, 2")
def relief(t: Tables) -> DataFrame:
    return G.spread(grid(t), "v", 1).select("row", "col", F.round("relief", 6).alias("relief"), F.round("roughness", 6).alias("roughness"))


@query("q87_cell_ids", "SELECT p_partkey, printf('r%05dc%05d', CAST(floor(((p_partkey * 31) % 5000 - 100.0) / 90) AS INT), CAST(floor(((p_partkey * 17) % 5000 - 100.0) / 90) AS INT)) AS cell FROM part WHERE (p_partkey * 31) % 5000 >= 100 AND (p_partkey * 17) % 5000 >= 100")
def cell_ids(t: Tables) -> DataFrame:
    x, y = (F.col("p_partkey") * 17) % 5000, (F.col("p_partkey") * 31) % 5000
    return t.part.filter((x >= 100) & (y >= 100)).select("p_partkey", cell_id(x, y, 90.0, (100.0, 100.0)).alias("cell"))


LAYERS_SQL = GRID_SQL + """, l AS (SELECT id, (rank() OVER (ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY v)) / count(*) OVER () AS t1, (rank() OVER (ORDER BY size) - 1 + 0.5 * count(*) OVER (PARTITION BY size)) / count(*) OVER () AS t2,
    ((id * 7919) % 997 + 1) / 1000.0 AS x1, ((id * 31) % 101) / 100.0 AS obs FROM g)"""


def layers(t: Tables) -> DataFrame:
    """Percentile layers of all cells. Ranks are over distinct values with their counts, not over cells."""
    g = grid(t).withColumn("k", F.lit(1))
    g = O.midranks(O.midranks(g, ["k"], "v", "p1"), ["k"], "size", "p2")
    return g.select("id", (F.col("p1") / 100).alias("t1"), (F.col("p2") / 100).alias("t2"), (((F.col("id") * 7919) % 997 + 1) / 1000.0).alias("x1"), (((F.col("id") * 31) % 101) / 100.0).alias("obs"))


@query("q221_priority_rank", f"WITH {LAYERS_SQL}, s AS (SELECT id, exp((ln(t1) + ln(t2)) / 2) AS terrain, x1 AS exposure, exp((ln(t1) + ln(t2)) / 2) * x1 * obs AS priority FROM l) SELECT id, round(terrain, 8) AS terrain, round(exposure, 8) AS exposure, round(priority, 8) AS priority, CASE WHEN priority IS NULL THEN 'NOT_RANKED' ELSE 'RANKED' END AS status FROM s")
def priority_rank(t: Tables) -> DataFrame:
    a, b, p = G.priority([F.col("t1"), F.col("t2")], [F.col("x1")], F.col("obs"))
    return layers(t).select("id", F.round(a, 8).alias("terrain"), F.round(b, 8).alias("exposure"), F.round(p, 8).alias("priority"), F.when(p.isNull(), "NOT_RANKED").otherwise("RANKED").alias("status"))


@query("q219_top_five", f"WITH {LAYERS_SQL} SELECT id FROM l ORDER BY round(exp((ln(t1) + ln(t2)) / 2) * x1 * obs, 8) DESC, id LIMIT 5")
def top_five(t: Tables) -> DataFrame:
    p = priority_rank(t)
    return p.orderBy(*G.candidate_order("id", "priority")).limit(5).select("id")


@query("q220_leave_one_layer_out", f"""WITH {LAYERS_SQL}, v AS (SELECT id, '' AS left_out, exp((ln(t1) + ln(t2)) / 2) * x1 * obs AS s FROM l UNION ALL SELECT id, 't1', t2 * x1 * obs FROM l UNION ALL SELECT id, 't2', t1 * x1 * obs FROM l)
    SELECT left_out, CAST(place AS INT) AS place, id FROM (SELECT left_out, id, row_number() OVER (PARTITION BY left_out ORDER BY round(s, 10) DESC, id) AS place FROM v) WHERE place <= 5""")
def leave_one_out(t: Tables) -> DataFrame:
    return G.top_without_each(layers(t), "id", ["t1", "t2"], ["x1"], "obs")


@query("q229_first_member", "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def first_member(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("q227_modal_value", "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, CAST(min_by(p_size, (-n, p_size)) AS INT) AS modal FROM c GROUP BY 1")
def modal(t: Tables) -> DataFrame:
    c = t.part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).cast("int").alias("modal"))


@query("q226_best_choice", "SELECT o_custkey, min_by(o_orderkey, (o_orderpriority, o_orderkey)) AS chosen, count(*) AS n FROM orders GROUP BY 1")
def best_choice(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("chosen"), F.count(F.lit(1)).alias("n"))
