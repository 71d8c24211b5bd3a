"""Queries on boxes, points and polygons, detectors and resampled nulls (inventory 2.2, 2.3, 2.8, 2.9c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import stats as S
from panelforge.operators import cases as K
from panelforge.operators import order as O
from panelforge.operators import spatial as P
from panelforge.plans.metrics import CASES_SQL, cases
from panelforge.plans.panels import EVENT_SQL, UNIT_SQL, unit_daily
from panelforge.plans.registry import Tables, query

BOX_SQL = "p AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 1000)::DOUBLE AS x0, ((p_partkey * 104729) % 1000)::DOUBLE AS y0, ((p_partkey * 7919) % 1000 + p_size)::DOUBLE AS x1, ((p_partkey * 104729) % 1000 + 20)::DOUBLE AS y1 FROM part), s AS (SELECT s_suppkey AS id, ((s_suppkey * 6007) % 1000)::DOUBLE AS x0, ((s_suppkey * 9173) % 1000)::DOUBLE AS y0, ((s_suppkey * 6007) % 1000 + 30)::DOUBLE AS x1, ((s_suppkey * 9173) % 1000 + 30)::DOUBLE AS y1 FROM supplier)"


def boxes(df: DataFrame, key: str, a: int, b: int, wide: Column, high: Column) -> DataFrame:
    k = F.col(key).cast("long")
    x, y = ((k * a) % 1000).cast("double"), ((k * b) % 1000).cast("double")
    return df.select(F.col(key).alias("id"), x.alias("x0"), y.alias("y0"), (x + wide).alias("x1"), (y + high).alias("y1"))


def parts(t: Tables) -> DataFrame:
    return boxes(t.part, "p_partkey", 7919, 104729, F.col("p_size"), F.lit(20))


def suppliers(t: Tables) -> DataFrame:
    return boxes(t.supplier, "s_suppkey", 6007, 9173, F.lit(30), F.lit(30))


@query("q121_box_overlaps", f"""WITH {BOX_SQL}, o AS (SELECT p.id AS a, s.id AS b, (least(p.x1, s.x1) - greatest(p.x0, s.x0)) * (least(p.y1, s.y1) - greatest(p.y0, s.y0)) AS shared, (p.x1 - p.x0) * (p.y1 - p.y0) AS pa, (s.x1 - s.x0) * (s.y1 - s.y0) AS sa FROM p JOIN s ON p.x0 < s.x1 AND s.x0 < p.x1 AND p.y0 < s.y1 AND s.y0 < p.y1)
    SELECT a, b, round(shared / (pa + sa - shared), 8) AS iou, round(shared / pa, 8) AS of_a, CASE WHEN count(*) OVER (PARTITION BY b) > 1 THEN 'MANY' ELSE 'ONE' END || '_TO_' || CASE WHEN count(*) OVER (PARTITION BY a) > 1 THEN 'MANY' ELSE 'ONE' END AS pattern FROM o""")
def overlaps(t: Tables) -> DataFrame:
    o = P.box_overlaps(parts(t), suppliers(t), 50.0)
    return o.select("a", "b", F.round("iou", 8).alias("iou"), F.round("of_a", 8).alias("of_a"), "pattern")


@query("q122_point_in_box", f"WITH {BOX_SQL} SELECT p.id AS point, s.id AS box, CASE WHEN p.x0 IN (s.x0, s.x1) OR p.y0 IN (s.y0, s.y1) THEN 'boundary' ELSE 'inside' END AS place FROM p JOIN s ON p.x0 BETWEEN s.x0 AND s.x1 AND p.y0 BETWEEN s.y0 AND s.y1")
def point_in_box(t: Tables) -> DataFrame:
    """Places of points meet places of boxes in the grid cells that a box touches: one cell a point, so every pair comes out
    once; the pairs are carried out to points and boxes."""
    cell = 50.0
    points = parts(t).select(F.col("id").alias("point"), F.col("x0").alias("px"), F.col("y0").alias("py"))
    spots = points.select("px", "py").distinct().withColumn("gx", F.floor(F.col("px") / cell)).withColumn("gy", F.floor(F.col("py") / cell))
    grid = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    side = ["x0", "y0", "x1", "y1"]
    b = suppliers(t).withColumnRenamed("id", "box")
    met = spots.join(b.select(*side).distinct().withColumn("gx", grid("x0", "x1")).withColumn("gy", grid("y0", "y1")), ["gx", "gy"]).filter(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    edge = (F.col("px") == F.col("x0")) | (F.col("px") == F.col("x1")) | (F.col("py") == F.col("y0")) | (F.col("py") == F.col("y1"))
    met = met.select("px", "py", *side, F.when(edge, "boundary").otherwise("inside").alias("place"))
    return O.carried_out(met, points, ["px", "py"], b, side).select("point", "box", "place")


RINGS = {"west": [(100.5, 100.5), (420.5, 60.5), (480.5, 500.5), (60.5, 440.5)], "east": [(550.5, 120.5), (930.5, 200.5), (700.5, 520.5), (860.5, 900.5), (520.5, 700.5)]}
RING_SQL = "e(name, x, y, u, v) AS (VALUES " + ", ".join(f"('{n}', {r[i][0]}, {r[i][1]}, {r[(i + 1) % len(r)][0]}, {r[(i + 1) % len(r)][1]})" for n, r in RINGS.items() for i in range(len(r))) + ")"


def ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in points])


@query("q123_polygon_class", f"""WITH {BOX_SQL}, {RING_SQL}, c AS (SELECT p.id, name, count(*) FILTER ((y > p.y0) <> (v > p.y0) AND p.x0 < (u - x) * (p.y0 - y) / (v - y) + x) % 2 = 1 AS within FROM p, e GROUP BY 1, 2)
    SELECT id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (within), 'outside') AS class FROM c GROUP BY 1""")
def polygon_class(t: Tables) -> DataFrame:
    """Which of a few named polygons a point lies in. The polygons are literals of the plan."""
    named = [F.when(P.inside(F.col("x0"), F.col("y0"), ring(r)), n) for n, r in sorted(RINGS.items())]
    found = F.array_join(F.array_compact(F.array(*named)), ",")
    return parts(t).select("id", F.when(found == "", "outside").otherwise(found).alias("class"))


@query("q453_valid_polygons", "SELECT p_partkey, CASE WHEN p_size > 3 THEN round(p_size * (p_size - 3) / 2.0, 6) END AS area FROM part WHERE p_size > 3")
def valid_polygons(t: Tables) -> DataFrame:
    """Triangles with an area; the others are no polygons."""
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    area = P.ring_area(F.array(corner(zero, zero), corner(s, zero), corner(s, s - 3)))
    return t.part.filter("p_size >= 3").select("p_partkey", F.round(area, 6).alias("area")).filter("area > 0")


@query("q454_inventory_bind", "SELECT year(o_orderdate)::INT AS epoch, count(*) AS features, count(*) FILTER (c_custkey IS NULL) AS unknown, count(*) FILTER (o_totalprice > 1000) AS valid FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1")
def inventory(t: Tables) -> DataFrame:
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("known"))
    return t.orders.join(known, "o_custkey", "left").groupBy(F.year("o_orderdate").alias("epoch")).agg(F.count(F.lit(1)).alias("features"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("o_totalprice") > 1000, 1)).alias("valid"))


# Fixed values of the detectors.
RAPID, ANOMALY_Z, LEAST_SOURCES = 20.0, 2.5, 3
SENSED_SQL = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity > greatest(20, 1.5 * abs(l_tax * 300)) AS melt, l_discount >= 0.08 AS dry, l_tax >= 0.06 AS bare, l_returnflag = 'R' AS snow, l_linestatus = 'F' AS loading, (l_quantity - 25) / 10 AS z FROM lineitem), g AS (SELECT *, melt::INT + dry::INT + bare::INT + snow::INT + loading::INT AS n FROM f)"


def sensed(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    f = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (q > F.greatest(F.lit(RAPID), 1.5 * F.abs(F.col("l_tax") * 300))).alias("melt"), (F.col("l_discount") >= 0.08).alias("dry"), (F.col("l_tax") >= 0.06).alias("bare"), (F.col("l_returnflag") == "R").alias("snow"), (F.col("l_linestatus") == "F").alias("loading"), ((q - 25) / 10).alias("z"))
    return f.withColumn("n", sum((F.col(c).cast("int") for c in ("dry", "bare", "snow", "loading")), F.col("melt").cast("int")))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("q89_five_detectors", f"WITH {SENSED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, n, n >= 3 AS discrepancy FROM g")
def detectors(t: Tables) -> DataFrame:
    return sensed(t).select(*KEYS, "n", (F.col("n") >= LEAST_SOURCES).alias("discrepancy"))


@query("q423_rapid_melt", f"WITH {SENSED_SQL} SELECT l_suppkey, count(*) AS rows_, count(*) FILTER (melt) AS melts FROM g GROUP BY 1")
def melt(t: Tables) -> DataFrame:
    return sensed(t).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows_"), F.count(F.when(F.col("melt"), 1)).alias("melts"))


@query("q424_states", f"WITH {SENSED_SQL}, s AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE z END AS z, n FROM g) SELECT CASE WHEN n < 3 AND z IS NULL THEN 'UNVERIFIED' WHEN n < 3 THEN 'NORMAL' WHEN abs(z) >= 2.5 AND n >= 3 THEN 'ANOMALY' ELSE 'WATCH' END AS state, count(*) AS rows_ FROM s GROUP BY 1")
def states(t: Tables) -> DataFrame:
    """Without a discrepancy unverified or normal; with one an anomaly if far off and seen by enough sources, else a watch."""
    s = sensed(t).withColumn("z", F.when(F.col("l_partkey") % 50 != 0, F.col("z")))
    some = F.col("n") >= LEAST_SOURCES
    state = F.when(~some & F.col("z").isNull(), "UNVERIFIED").when(~some, "NORMAL").when((F.abs("z") >= ANOMALY_Z) & some, "ANOMALY").otherwise("WATCH")
    return s.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows_"))


@query("q90_attribution", f"WITH {SENSED_SQL} SELECT CASE WHEN snow AND NOT dry THEN CASE WHEN bare THEN 'FORCING_ERROR' ELSE 'SENSING_GAP' END WHEN loading THEN CASE WHEN dry AND bare THEN 'SENSING_GAP' ELSE 'THRESHOLD' END WHEN melt THEN 'THRESHOLD' ELSE 'UNATTRIBUTED' END AS bucket, CASE WHEN snow AND NOT dry THEN CASE WHEN bare THEN 0.7 ELSE 0.6 END WHEN loading THEN CASE WHEN dry AND bare THEN 0.8 ELSE 0.5 END WHEN melt THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS rows_ FROM g GROUP BY 1, 2")
def attribution(t: Tables) -> DataFrame:
    """A rule table: the first rule that holds gives a bucket and its confidence."""
    said = lambda name, c: F.struct(F.lit(name).alias("bucket"), F.lit(c).alias("confidence"))
    rule = (
        F.when(F.col("snow") & ~F.col("dry") & F.col("bare"), said("FORCING_ERROR", 0.7))
        .when(F.col("snow") & ~F.col("dry"), said("SENSING_GAP", 0.6))
        .when(F.col("loading") & F.col("dry") & F.col("bare"), said("SENSING_GAP", 0.8))
        .when(F.col("loading") | F.col("melt"), said("THRESHOLD", 0.5))
        .otherwise(said("UNATTRIBUTED", 0.0))
    )
    return sensed(t).select(rule.alias("r")).select("r.*").groupBy("bucket", "confidence").agg(F.count(F.lit(1)).alias("rows_"))


@query("q176_distinct_counts", "SELECT year(l_shipdate)::INT AS year, count(DISTINCT l_suppkey) AS units, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count_distinct("l_suppkey").alias("units"), F.count_distinct("l_partkey").alias("parts"))


Z_SQL = "z AS (SELECT unit, day, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM unit_daily WINDOW w AS (PARTITION BY unit, month(day)))"


@query("q188_event_zscores", f"WITH {UNIT_SQL}, {EVENT_SQL}, {Z_SQL} SELECT e.unit, event_day, round(max(abs(z)), 6) AS most, round(avg(abs(z)), 6) AS mean, count(*) FILTER (abs(z) > 2) AS over FROM e JOIN z ON e.unit = z.unit AND z.day BETWEEN event_day - 7 AND event_day GROUP BY 1, 2")
def event_zscores(t: Tables) -> DataFrame:
    u = unit_daily(t)
    usual = u.groupBy("unit", F.month("day").alias("m")).agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    z = u.withColumn("m", F.month("day")).join(usual, ["unit", "m"]).select("unit", "day", F.abs((F.col("v") - F.col("a")) / F.col("s")).alias("z"))
    s = u.groupBy("unit").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    e = u.join(F.broadcast(s), "unit").filter("v > m + 2 * s").select("unit", F.col("day").alias("event_day"))
    near = e.withColumn("day", F.explode(F.sequence(F.date_sub("event_day", 7), F.col("event_day")))).join(z, ["unit", "day"])
    return near.groupBy("unit", "event_day").agg(F.round(F.max("z"), 6).alias("most"), F.round(F.avg("z"), 6).alias("mean"), F.count(F.when(F.col("z") > 2, 1)).alias("over"))


@query("q278_strata", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c, quantile_cont(o_custkey, 1 / 3.0) AS d, quantile_cont(o_custkey, 2 / 3.0) AS e FROM orders) SELECT ((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT)::VARCHAR || '|' || ((o_custkey >= d)::INT + (o_custkey >= e)::INT)::VARCHAR || '|' || o_orderstatus AS stratum, count(*) AS n FROM orders, q GROUP BY 1")
def strata(t: Tables) -> DataFrame:
    """Quartile, tercile and region as one label."""
    q = O.quantiles(t.orders, [], "o_totalprice", [0.25, 0.5, 0.75]).withColumnRenamed("q", "x").join(F.broadcast(O.quantiles(t.orders, [], "o_custkey", [1 / 3, 2 / 3]).withColumnRenamed("q", "y")))
    above = lambda c, a, n: sum(((F.col(c) >= F.col(a)[i]).cast("int") for i in range(1, n)), (F.col(c) >= F.col(a)[0]).cast("int")).cast("string")
    label = F.concat_ws("|", above("o_totalprice", "x", 3), above("o_custkey", "y", 2), "o_orderstatus")
    return t.orders.join(F.broadcast(q)).groupBy(label.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def draw(*keys: Column) -> Column:
    """A number in [0, 1) from an MD5 of the keys: the same in any engine."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


DRAW_SQL = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"
REPS = 200


@query("q288_group_bootstrap", f"""WITH g AS (SELECT n_regionkey AS stratum, n_nationkey AS unit, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation),
    m AS (SELECT c_nationkey AS unit, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1), d AS (SELECT r::INT AS replicate, g.stratum, floor({DRAW_SQL.format("r || '|' || g.stratum || '|' || g.i")} * g.size)::BIGINT AS pick FROM g, range({REPS}) x(r))
    SELECT replicate, round(sum(s) / sum(n), 6) AS mean FROM d JOIN g ON d.stratum = g.stratum AND d.pick = g.i JOIN m ON m.unit = g.unit GROUP BY 1""")
def group_bootstrap(t: Tables) -> DataFrame:
    """Groups drawn anew within their strata; each carries its sums, so a replicate costs groups, not rows."""
    w = Window.partitionBy("n_regionkey")
    g = t.nation.select(F.col("n_regionkey").alias("stratum"), F.col("n_nationkey").alias("unit"), (F.row_number().over(w.orderBy("n_nationkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("size"))
    m = t.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    d = g.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))))
    d = d.select("replicate", "stratum", F.floor(draw(F.col("replicate"), F.col("stratum"), F.col("i")) * F.col("size")).cast("int").alias("i"))
    return d.join(g.select("stratum", "i", "unit"), ["stratum", "i"]).join(m, "unit").groupBy("replicate").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@query("q303_uncertainty", f"""WITH {CASES_SQL}, c AS (SELECT source, sum((p - y) * (p - y)) AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS size FROM cases GROUP BY source), d AS (SELECT r, floor({DRAW_SQL.format("r || '|' || c.i")} * c.size)::BIGINT AS pick FROM c, range({REPS}) x(r)), b AS (SELECT r, sum(s) / sum(n) AS v FROM d JOIN c ON d.pick = c.i GROUP BY 1)
    SELECT round(quantile_cont(v, 0.025), 8) AS low, round(quantile_cont(v, 0.975), 8) AS high, count(*) AS replicates FROM b""")
def uncertainty(t: Tables) -> DataFrame:
    """An interval of the Brier score by drawing clusters (sources) anew."""
    c = cases(t).groupBy("source").agg(F.sum((F.col("p") - F.col("y")) ** 2).alias("s"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    c = O.running(c, [], ["source"], "one", "k").withColumn("i", F.col("k") - 1)
    size = c.agg(F.count(F.lit(1)).alias("size"))
    d = c.select("i").join(F.broadcast(size)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).select("r", F.floor(draw(F.col("r"), F.col("i")) * F.col("size")).alias("i"))
    b = d.join(c, "i").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("v"))
    return b.agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("replicates")).select(F.round(F.col("q")[0], 8).alias("low"), F.round(F.col("q")[1], 8).alias("high"), "replicates")


@query("q280_bootstrap_auc", f"""WITH {CASES_SQL}, s AS (SELECT lang, doc_id % 20 AS score, sum(y) AS p, sum(1 - y) AS q FROM cases GROUP BY 1, 2), l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT lang FROM cases)), d AS (SELECT r::INT AS r, floor({DRAW_SQL.format("r || '|' || l.i")} * l.size)::BIGINT AS pick FROM l, range({REPS}) x(r)),
    c AS (SELECT r, score, sum(p) AS p, sum(q) AS q FROM d JOIN l ON d.pick = l.i JOIN s ON s.lang = l.lang GROUP BY 1, 2), w AS (SELECT r, p, q, coalesce(sum(q) OVER (PARTITION BY r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT r AS replicate, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 8) AS auc FROM w GROUP BY 1""")
def bootstrap_auc(t: Tables) -> DataFrame:
    """AUC of replicates of blocks (languages), from counts by score."""
    rows = cases(t).withColumn("score", F.col("doc_id") % 20).groupBy("lang", "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    names = rows.select("lang").distinct().withColumn("one", F.lit(1))
    names = O.running(names, [], ["lang"], "one", "k").select("lang", (F.col("k") - 1).alias("i"))
    size = names.agg(F.count(F.lit(1)).alias("size"))
    d = names.select("i").join(F.broadcast(size)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).select("replicate", F.floor(draw(F.col("replicate"), F.col("i")) * F.col("size")).alias("i"))
    c = d.join(names, "i").join(rows, "lang").groupBy("replicate", "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy("replicate").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    part = c.withColumn("w", F.col("p") * (F.coalesce(F.sum("q").over(w), F.lit(0)) + F.col("q") / 2)).groupBy("replicate").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return part.select("replicate", F.round(F.col("w") / F.nullif(F.col("p") * F.col("q"), F.lit(0)), 8).alias("auc"))


@query("q283_placebo_shuffle", f"""WITH {CASES_SQL}, a AS (SELECT r::INT AS r, lang, doc_id, y, p, row_number() OVER (PARTITION BY r, lang ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY r, lang ORDER BY md5(r || '|' || doc_id), doc_id) AS j FROM cases, range({REPS}) x(r)) SELECT a.r AS replicate, sum(b.y)::BIGINT AS hits FROM a JOIN a b ON a.r = b.r AND a.lang = b.lang AND a.i = b.j WHERE a.p >= 0.5 GROUP BY 1""")
def placebo_shuffle(t: Tables) -> DataFrame:
    """Labels dealt anew within strata: what chance alone puts under a high score."""
    c = cases(t).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).withColumn("h", F.md5(F.concat_ws("|", "replicate", "doc_id").cast("binary"))).withColumn("one", F.lit(1))
    i = O.running(c.select("replicate", "lang", "doc_id", "p", "one"), ["replicate", "lang"], ["doc_id"], "one", "i").filter("p >= 0.5").select("replicate", "lang", "i")
    j = O.running(c.select("replicate", "lang", "doc_id", "h", "y", "one"), ["replicate", "lang"], ["h", "doc_id"], "one", "i").select("replicate", "lang", "i", "y")
    return i.hint("merge").join(j, ["replicate", "lang", "i"]).groupBy("replicate").agg(F.sum("y").alias("hits"))


@query("q289_placebo_controls", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 10")
def placebo_controls(t: Tables) -> DataFrame:
    """Ten pseudo-events of each stratum, by the order of a seeded hash: partial lists of ten, never a sorted stratum."""
    h = F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")).cast("binary"))
    rows = t.orders.select("o_orderpriority", "o_orderkey", h.alias("h"))
    w = Window.partitionBy("o_orderpriority").orderBy("h", "o_orderkey")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 10").select("o_orderkey")


@query("q379_joint_permutation", "SELECT a.p_partkey, b.p_size, b.p_retailprice FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) a JOIN (SELECT p_size, p_retailprice, row_number() OVER (ORDER BY md5('3|' || p_partkey), p_partkey) AS i FROM part) b USING (i)")
def joint_permutation(t: Tables) -> DataFrame:
    """Feature rows dealt anew as a whole; ranks come from range partitions."""
    p = t.part.select("p_partkey", "p_size", "p_retailprice", F.md5(F.concat(F.lit("3|"), F.col("p_partkey").cast("string")).cast("binary")).alias("h"), F.lit(1).alias("one"))
    a = O.running(p.select("p_partkey", "one"), [], ["p_partkey"], "one", "i").select("p_partkey", "i")
    b = O.running(p, [], ["h", "p_partkey"], "one", "i").select("i", "p_size", "p_retailprice")
    return a.join(b, "i").select("p_partkey", "p_size", "p_retailprice")


@query("q269_composite_null", f"""WITH {UNIT_SQL}, d AS (SELECT unit, v, row_number() OVER (PARTITION BY unit ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY unit) AS size FROM unit_daily), p AS (SELECT r::INT AS r, unit, floor({DRAW_SQL.format("r || '|' || unit")} * size)::BIGINT AS i FROM (SELECT DISTINCT unit, size FROM d), range({REPS}) x(r)) SELECT r AS replicate, round(avg(v), 6) AS mean FROM p JOIN d USING (unit, i) GROUP BY 1""")
def composite_null(t: Tables) -> DataFrame:
    """One draw a unit and replicate: the null of a composite mean."""
    d = O.running(unit_daily(t).withColumn("one", F.lit(1)), ["unit"], ["day"], "one", "k").select("unit", "v", (F.col("k") - 1).alias("i"))
    size = d.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    p = size.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).select("replicate", "unit", F.floor(draw(F.col("replicate"), F.col("unit")) * F.col("size")).alias("i"))
    return p.join(d, ["unit", "i"]).groupBy("replicate").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("q308_noise_floor", f"WITH {UNIT_SQL}, r AS (SELECT unit, sqrt(avg(v * v)) AS rms FROM unit_daily GROUP BY unit, date_trunc('month', day)) SELECT unit, round(quantile_cont(rms, 0.1), 6) AS floor_, round(quantile_cont(rms, 0.9) / quantile_cont(rms, 0.1), 6) AS snr FROM r GROUP BY 1")
def noise_floor(t: Tables) -> DataFrame:
    r = unit_daily(t).groupBy("unit", F.trunc("day", "month").alias("m")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return O.quantiles(r, ["unit"], "rms", [0.1, 0.9]).select("unit", F.round(F.col("q")[0], 6).alias("floor_"), F.round(F.col("q")[1] / F.col("q")[0], 6).alias("snr"))


@query("q316_matrix_digest", "SELECT count(*) AS n, sum(('0x' || substr(sha256(p_partkey::VARCHAR || '|' || printf('%.6f', p_retailprice)), 1, 12))::BIGINT)::BIGINT AS digest FROM part")
def matrix_digest(t: Tables) -> DataFrame:
    from panelforge.operators.tables import column_digests

    return column_digests(t.part.select(F.concat_ws("|", F.col("p_partkey").cast("string"), F.format_string("%.6f", "p_retailprice")).alias("k")), ["k"]).select("n", "digest")


@query("q374_unit_by_ratio", "SELECT p_brand, CASE WHEN abs(r - 1) < 0.1 THEN 'm' WHEN abs(r - 0.001) < 0.0001 THEN 'km' ELSE 'unknown' END AS unit FROM (SELECT p_brand, quantile_cont(CASE WHEN p_brand < 'Brand#2' THEN p_retailprice / 1000 ELSE p_retailprice END / p_retailprice, 0.5) AS r FROM part GROUP BY 1)")
def unit_by_ratio(t: Tables) -> DataFrame:
    ratio = F.when(F.col("p_brand") < "Brand#2", F.col("p_retailprice") / 1000).otherwise(F.col("p_retailprice")) / F.col("p_retailprice")
    q = O.quantiles(t.part.select("p_brand", ratio.alias("r")), ["p_brand"], "r", [0.5]).select("p_brand", F.col("q")[0].alias("r"))
    return q.select("p_brand", F.when(F.abs(F.col("r") - 1) < 0.1, "m").when(F.abs(F.col("r") - 0.001) < 0.0001, "km").otherwise("unknown").alias("unit"))


@query("q475_metric_bundle", f"""WITH {CASES_SQL}, b AS (SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM cases GROUP BY 1), e AS (SELECT sum(n * abs(mp - my)) / sum(n) AS calibration FROM b) SELECT count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg((p - y) * (p - y)), 8) AS brier, round(any_value(calibration), 8) AS calibration, round(count(*) FILTER (y = 1 AND p >= 0.5) / sum(y), 8) AS event_recall FROM cases, e""")
def bundle(t: Tables) -> DataFrame:
    """Brier score, calibration error over ten bins and recall of all cases in one row."""
    c = cases(t).withColumn("k", F.lit(1))
    bins = S.calibration_bins(c, ["k"], "y", "p", 10).filter("n > 0").agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("mean_truth"))) / F.sum("n")).alias("calibration"))
    m = K.core_metrics(c, ["k"], "y", "p", 0.5).join(c.groupBy("k").agg(F.sum("y").alias("n_positive")), "k")
    return m.join(F.broadcast(bins)).select("n", "n_positive", F.round("brier", 8).alias("brier"), F.round("calibration", 8).alias("calibration"), F.round("event_recall", 8).alias("event_recall"))


@query("q315_matrix_audit", "SELECT name, CASE WHEN n = 0 THEN 'EMPTY' WHEN low = high THEN 'CONSTANT' WHEN low < 0 THEN 'NEGATIVE' ELSE 'OK' END AS verdict FROM (SELECT 'l_tax' AS name, count(l_tax) AS n, min(l_tax) AS low, max(l_tax) AS high FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity), min(l_quantity), max(l_quantity) FROM lineitem)")
def matrix_audit(t: Tables) -> DataFrame:
    from panelforge.operators.tables import column_audit

    a = column_audit(t.lineitem, {"l_tax": "predictor", "l_quantity": "label"})
    return a.select("name", F.when(F.col("n") == 0, "EMPTY").when(F.col("low") == F.col("high"), "CONSTANT").when(F.col("low") < 0, "NEGATIVE").otherwise("OK").alias("verdict"))


@query("q120_point_census", f"WITH {BOX_SQL}, d AS (SELECT p.id, min(sqrt((p.x0 - s.x0) ** 2 + (p.y0 - s.y0) ** 2)) AS d FROM p JOIN s ON abs(p.x0 - s.x0) <= 100 AND abs(p.y0 - s.y0) <= 100 GROUP BY 1) SELECT count(*) FILTER (d <= 10) AS within_10, count(*) FILTER (d <= 50) AS within_50, count(*) FILTER (d <= 100) AS within_100 FROM d")
def census(t: Tables) -> DataFrame:
    """How many points have a feature within each of some distances."""
    from panelforge.operators.events import nearest_distance

    at = lambda df: df.select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    d = nearest_distance(at(parts(t)), at(suppliers(t)), "id", "x", "y", 100.0).withColumnRenamed("distance", "d")
    return d.agg(*[F.count(F.when(F.col("d") <= k, 1)).alias(f"within_{k}") for k in (10, 50, 100)])
