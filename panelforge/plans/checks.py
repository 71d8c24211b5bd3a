"""Queries on nearest cells, reference distributions, zones, coercions and scope counts (the rest of 2.1 to 2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as X
from panelforge.operators import order as O
from panelforge.operators import events as E
from panelforge.plans.panels import UNIT_SQL, unit_daily
from panelforge.plans.registry import Tables, query


@query("q2_nearest_cell", "SELECT min_by(p_partkey % 60, (abs((p_partkey % 60) - 27.5), -(p_partkey % 60))) AS lat, min_by(p_partkey % 90, (abs((p_partkey % 90) - 43.5), p_partkey % 90)) AS lon FROM part")
def nearest_cell(t: Tables) -> DataFrame:
    lat, lon = F.col("p_partkey") % 60, F.col("p_partkey") % 90
    return t.part.agg(F.min_by(lat, F.struct(F.abs(lat - 27.5), -lat)).alias("lat"), F.min_by(lon, F.struct(F.abs(lon - 43.5), lon)).alias("lon"))


@query("q8_assembly_without_loss", "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT count(*) FILTER (a.day IS NOT NULL AND b.day IS NOT NULL) AS both, count(*) FILTER (b.day IS NULL) AS left_only, count(*) FILTER (a.day IS NULL) AS right_only FROM a FULL JOIN b ON a.day = b.day")
def assembly(t: Tables) -> DataFrame:
    a = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("a", F.lit(1))
    b = t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct().withColumn("b", F.lit(1))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return a.join(b, "day", "full").agg(n(F.col("a").isNotNull() & F.col("b").isNotNull(), "both"), n(F.col("b").isNull(), "left_only"), n(F.col("a").isNull(), "right_only"))


@query("q49_missingness", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice < 20000) AS masked, round(avg((o_totalprice < 20000)::INT), 8) AS share FROM orders GROUP BY 1")
def missingness(t: Tables) -> DataFrame:
    gone = F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice")).isNull()
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(gone, 1)).alias("masked"), F.round(F.avg(gone.cast("int")), 8).alias("share"))


@query("q73_candidate_class", "SELECT c_custkey, CASE WHEN n_name = 'NATION_1' THEN 'exact' WHEN contains(n_name, 'NATION_1') THEN 'contains' WHEN n_regionkey = 1 THEN 'transboundary' ELSE 'none' END AS class FROM customer JOIN nation ON c_nationkey = n_nationkey")
def candidate_class(t: Tables) -> DataFrame:
    n = F.col("n_name")
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", F.when(n == "NATION_1", "exact").when(n.contains("NATION_1"), "contains").when(F.col("n_regionkey") == 1, "transboundary").otherwise("none").alias("class"))


@query("q77_record_validation", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN NOT (l_quantity BETWEEN 1 AND 40) THEN 'quantity' END, CASE WHEN NOT l_discount <= l_tax + 0.05 THEN 'discount' END, CASE WHEN NOT l_returnflag IN ('A', 'N') THEN 'flag' END], lambda x: x IS NOT NULL), '|') AS problems FROM lineitem")
def validation(t: Tables) -> DataFrame:
    p = X.problems((~F.col("l_quantity").between(1, 40), "quantity"), (~(F.col("l_discount") <= F.col("l_tax") + 0.05), "discount"), (~F.col("l_returnflag").isin("A", "N"), "flag"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(p, "|").alias("problems"))


@query("q83_forbidden_keys", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS rejected FROM events")
def forbidden(t: Tables) -> DataFrame:
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return t.events.select("event_id", F.arrays_overlap(keys, F.array(F.lit("k"))).alias("rejected"))


@query("q157_scoped_counts", "SELECT r_name, count(DISTINCT s_suppkey) AS registered, count(DISTINCT CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey END) AS verified FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def scoped(t: Tables) -> DataFrame:
    j = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count_distinct("s_suppkey").alias("registered"), F.count_distinct(F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey"))).alias("verified"))


@query("q158_weighted_labels", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type AS label, round(sum(1.0 / n), 6) AS weight FROM events e JOIN d ON d.user_id = e.user_id AND d.day = CAST(e.ts AS DATE) GROUP BY 1")
def weighted_labels(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("k"))
    d = c.groupBy("user_id", "day").agg(F.sum("k").alias("n"))
    return c.join(d, ["user_id", "day"]).groupBy("label").agg(F.round(F.sum(F.col("k") / F.col("n")), 6).alias("weight"))


@query("q181_unit_observability", "WITH x AS (SELECT unnest(['s' || l_suppkey::VARCHAR, 'p' || (l_partkey % 20)::VARCHAR]) AS unit, l_shipdate FROM lineitem) SELECT unit, count(*) AS available, round(least(1.0, count(DISTINCT month(l_shipdate)) / 12.0), 8) AS fraction FROM x GROUP BY 1")
def unit_observability(t: Tables) -> DataFrame:
    units = F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")))
    x = t.lineitem.select(F.explode(units).alias("unit"), F.month("l_shipdate").alias("m"))
    return x.groupBy("unit").agg(F.count(F.lit(1)).alias("available"), F.round(F.least(F.lit(1.0), F.count_distinct("m") / 12.0), 8).alias("fraction"))


@query("q193_midrank_against_reference", "WITH r AS (SELECT p_retailprice AS v FROM part WHERE p_partkey % 3 <> 0), x AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_partkey % 3 = 0) SELECT p_partkey, round(100.0 * (count(*) FILTER (r.v < x.v) + 0.5 * count(*) FILTER (r.v = x.v)) / count(*), 8) AS percentile FROM x, r GROUP BY 1")
def midrank_reference(t: Tables) -> DataFrame:
    """Counts of reference values run over distinct values; the rows to be ranked join by value, never with all the reference."""
    p = t.part.select("p_partkey", F.col("p_retailprice").alias("v"), (F.col("p_partkey") % 3 != 0).cast("int").alias("ref"))
    c = p.groupBy("v").agg(F.sum("ref").alias("n"))
    w = O.running(c, [], ["v"], "n", "upto").withColumn("below", F.col("upto") - F.col("n"))
    total = p.agg(F.sum("ref").alias("all"))
    return p.filter("ref = 0").join(w, "v").join(F.broadcast(total)).select("p_partkey", F.round(100.0 * (F.col("below") + 0.5 * F.col("n")) / F.col("all"), 8).alias("percentile"))


@query("q198_window_reference", f"WITH {UNIT_SQL}, l AS (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY unit ORDER BY day) <> 1)::INT, 1) AS gap FROM unit_daily), r AS (SELECT *, sum(gap) OVER (PARTITION BY unit ORDER BY day) AS run FROM l), w AS (SELECT unit, day, CASE WHEN count(v) OVER x = 7 THEN sum(v) OVER x END AS s FROM r WINDOW x AS (PARTITION BY unit, run ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT unit, CAST(month(day) AS INT) AS month, count(s) AS windows, round(avg(s), 5) AS mean_sum, round(quantile_cont(s, 0.9), 5) AS q90 FROM w WHERE s IS NOT NULL GROUP BY 1, 2")
def window_reference(t: Tables) -> DataFrame:
    from panelforge.operators.windows import rolling

    w = rolling(unit_daily(t), ["unit"], "day", "v", 7).filter("rolled IS NOT NULL")
    return w.groupBy("unit", F.month("day").alias("month")).agg(F.count("rolled").alias("windows"), F.round(F.avg("rolled"), 5).alias("mean_sum"), F.round(F.percentile("rolled", 0.9), 5).alias("q90"))


@query("q214_gap_summary", "WITH g AS (SELECT user_id, date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)) AS gap FROM events) SELECT CAST(min(gap) AS INT) AS least, round(quantile_cont(gap, 0.5), 4) AS median, CAST(max(gap) AS INT) AS most, count(gap) AS n FROM g")
def gap_summary(t: Tables) -> DataFrame:
    g = t.events.select(F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))).alias("gap"))
    ends = g.agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.count("gap").alias("n"))
    return ends.join(F.broadcast(O.quantiles(g, [], "gap", [0.5]))).select("least", F.round(F.col("q")[0], 4).alias("median"), "most", "n")


@query("q312_distance_zones_all")
def zones_all(t: Tables) -> DataFrame:
    """Points of one place are one zone, so each place takes part once, by its smallest id: pairs grow with places, not with points."""
    p = placed(t.supplier)
    places = p.groupBy("x", "y").agg(F.min("id").alias("id"))
    zone = zoned(places.select("id", "x", "y")).join(places, F.col("node") == F.col("id")).select("x", "y", "zone")
    return p.join(zone, ["x", "y"]).select(F.col("id").alias("node"), "zone")


def placed(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return supplier.select(F.col("s_suppkey").alias("id"), (((k * 7919) % 1000) / 10.0).alias("x"), (((k * 104729) % 1000) / 10.0).alias("y"))


def zoned(p: DataFrame) -> DataFrame:
    off = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    at = p.withColumns({"gx": F.floor(F.col("x") / 5), "gy": F.floor(F.col("y") / 5)})
    near = at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "gx", "gy", off.alias("o")).select("b", "bx", "by", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    edges = at.join(near, ["gx", "gy"]).filter((F.col("id") < F.col("b")) & (F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= 5))
    roots = E.components(edges.select("id", "b"), "id", "b")
    return p.select(F.col("id").alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("zone"))


@query("q462_interval_width", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS INT) END AS width FROM orders")
def interval_width(t: Tables) -> DataFrame:
    k = (F.col("o_orderkey") % 40).cast("int")
    a = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    b = F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise(F.date_format(F.date_add("o_orderdate", k), "yyyy-MM-dd"))
    day = lambda s: F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return t.orders.select("o_orderkey", F.datediff(day(b), day(a)).alias("width"))


@query("q470_members_by_key", "SELECT CAST(n_regionkey AS INT) AS region, string_agg(n_name, '|' ORDER BY n_name) AS members FROM nation GROUP BY 1")
def members(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").cast("int").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("members"))


@query("q482_clamped_unit", "SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR abs(v) = 'inf'::DOUBLE THEN 0.0 ELSE least(1.0, greatest(0.0, v)) END AS p FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN value / 50 ELSE value / 500 END AS v FROM events)")
def clamped(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    v = F.when(k == 0, float("nan")).when(k == 1, F.col("value") / 50).otherwise(F.col("value") / 500)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return t.events.select("event_id", F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))).alias("p"))


@query("q493_strict_integers", r"SELECT o_orderkey, CASE WHEN regexp_matches(trim(s), '^[+-]?\d+$') THEN CAST(trim(s) AS BIGINT) END AS value FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' 17 ' WHEN 1 THEN '5.0' WHEN 2 THEN '' ELSE '-' || o_orderkey::VARCHAR END AS s FROM orders)")
def strict_integers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = F.trim(F.when(k == 0, " 17 ").when(k == 1, "5.0").when(k == 2, "").otherwise(F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))))
    return t.orders.select("o_orderkey", F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")).alias("value"))
