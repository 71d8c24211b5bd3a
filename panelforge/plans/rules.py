"""Queries on record rules: coercions, detectors, calendars, slots, merges, conflict and scope checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as X
from panelforge.operators import order as O
from panelforge.operators import windows as W
from panelforge.plans.panels import UNIT_SQL, unit_daily
from panelforge.plans.registry import Tables, query


@query("q352_calendar_universe", f"""WITH {UNIT_SQL}, c AS (SELECT unit, CAST(d AS DATE) AS day FROM (SELECT unit, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM unit_daily GROUP BY 1))
    SELECT c.unit, CAST(year(c.day) AS INT) AS year, count(*) AS expected, count(u.day) AS found FROM c LEFT JOIN unit_daily u USING (unit, day) GROUP BY 1, 2""")
def calendar(t: Tables) -> DataFrame:
    u = unit_daily(t)
    c = u.groupBy("unit").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("unit", F.explode(F.sequence("a", "b")).alias("day"))
    return c.join(u.withColumn("there", F.lit(1)), ["unit", "day"], "left").groupBy("unit", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("found"))


@query("q354_continuous_axis_all", """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2), c AS (SELECT user_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT user_id FROM h), (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE))::TIMESTAMP FROM events), (SELECT max(CAST(ts AS DATE))::TIMESTAMP FROM events), INTERVAL 1 DAY)) AS d))
    SELECT user_id, day, CASE WHEN n >= 2 THEN round(v, 6) END AS total FROM c LEFT JOIN h USING (user_id, day)""")
def continuous_all(t: Tables) -> DataFrame:
    return on_axis(t, t.events)


def on_axis(t: Tables, events: DataFrame) -> DataFrame:
    h = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    ends = t.events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    c = h.select("user_id").distinct().join(F.broadcast(ends)).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return c.join(h, ["user_id", "day"], "left").select("user_id", "day", F.when(F.col("n") >= 2, F.round("v", 6)).alias("total"))


@query("q356_group_rollup", """WITH c AS (SELECT o_custkey, min(o_orderdate) AS first_date, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS members FROM orders GROUP BY 1)
    SELECT o_custkey, members, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY first_date, o_custkey)::INT AS nth FROM c""")
def rollup(t: Tables) -> DataFrame:
    m = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    c = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"), F.array_join(F.transform(m, lambda x: x["o_orderkey"].cast("string")), ",").alias("members"))
    c = c.withColumn("k", F.col("o_custkey") % 10).withColumn("one", F.lit(1))
    return O.running(c, ["k"], ["first_date", "o_custkey"], "one", "nth").select("o_custkey", "members", F.col("nth").cast("int").alias("nth"))


@query("q364_apply_decisions", "SELECT c_custkey, coalesce(d.segment, c.c_mktsegment) AS segment, d.segment IS NOT NULL AS changed FROM customer c LEFT JOIN (SELECT o_custkey, max('REVIEWED') AS segment FROM orders WHERE o_totalprice > 400000 GROUP BY 1) d ON c_custkey = o_custkey")
def apply_decisions(t: Tables) -> DataFrame:
    d = t.orders.filter("o_totalprice > 400000").groupBy("o_custkey").agg(F.max(F.lit("REVIEWED")).alias("segment"))
    return t.customer.join(d, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("segment", "c_mktsegment").alias("segment"), F.col("segment").isNotNull().alias("changed"))


@query("q366_slots", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, e FROM (SELECT DISTINCT o_custkey FROM orders), range(1995, 2002) r(e)) SELECT CAST(e AS INT) AS epoch, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'single' ELSE 'several' END AS flag, count(*) AS slots FROM s LEFT JOIN y ON s.o_custkey = y.o_custkey AND y.y = e GROUP BY 1, 2")
def slots(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    s = t.orders.select("o_custkey").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    flag = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "single").otherwise("several")
    return s.join(y, ["o_custkey", "epoch"], "left").groupBy("epoch", flag.alias("flag")).agg(F.count(F.lit(1)).alias("slots"))


@query("q368_earliest_covariates", "SELECT o_custkey, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS price, min_by(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1")
def earliest(t: Tables) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_totalprice", at).alias("price"), F.min_by("o_orderpriority", at).alias("priority"))


@query("q370_pivot_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot(t: Tables) -> DataFrame:
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return p.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("q372_large_change", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS a FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, ln(a / lag(a) OVER (PARTITION BY o_custkey ORDER BY y)) AS ratio FROM y) SELECT o_custkey, count(*) FILTER (abs(ratio) > ln(1.2)) AS large, count(ratio) AS steps FROM r GROUP BY 1")
def large_change(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("a"))
    r = y.withColumn("ratio", F.ln(F.col("a") / F.lag("a").over(Window.partitionBy("o_custkey").orderBy("y"))))
    return r.groupBy("o_custkey").agg(F.count(F.when(F.abs("ratio") > F.ln(F.lit(1.2)), 1)).alias("large"), F.count("ratio").alias("steps"))


@query("q375_plan_product", "SELECT CAST(n_regionkey AS INT) AS region, v AS variable, CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (VALUES ('t'), ('p')) x(v) CROSS JOIN range(2000, 2003) r(y) CROSS JOIN range(6, 9) s(m)")
def plan_product(t: Tables) -> DataFrame:
    r = t.nation.select(F.col("n_regionkey").cast("int").alias("region")).distinct()
    return r.withColumn("variable", F.explode(F.array(F.lit("t"), F.lit("p")))).withColumn("year", F.explode(F.sequence(F.lit(2000), F.lit(2002)))).withColumn("month", F.explode(F.sequence(F.lit(6), F.lit(8))))


@query("q382_scope_conflicts", "SELECT CAST(floor(abs(s_acctbal)) AS BIGINT) % 50 AS basin, count(DISTINCT s_nationkey) AS owners FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1")
def scope(t: Tables) -> DataFrame:
    basin = F.floor(F.abs("s_acctbal")).cast("long") % 50
    return t.supplier.groupBy(basin.alias("basin")).agg(F.count_distinct("s_nationkey").alias("owners")).filter("owners > 1")


@query("q402_rank_finite_cells", "WITH g AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS v, p_size % 3 AS component FROM part), r AS (SELECT *, (rank() OVER (PARTITION BY component ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY component, v)) / count(*) OVER (PARTITION BY component) AS p FROM g WHERE v IS NOT NULL) SELECT g.p_partkey, round(100 * p, 8) AS percentile FROM g LEFT JOIN r USING (p_partkey)")
def rank_finite(t: Tables) -> DataFrame:
    g = t.part.select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("v"), (F.col("p_size") % 3).alias("component"))
    return O.midranks(g, ["component"], "v", "p").select("p_partkey", F.round("p", 8).alias("percentile"))


@query("q416_threshold_rule", "SELECT event_id, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE AND value >= 50 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS p FROM events")
def threshold_rule(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 50), 0.9).otherwise(0.1).alias("p"))


@query("q419_detectors", """SELECT l_orderkey, l_linenumber, coalesce(l_tax > 0.05 AND l_discount < 0.03, FALSE) AS loading, l_discount > 0.05 AND (l_tax IS NULL OR l_tax < 0.02) AS dry, coalesce(l_quantity > greatest(30, 1.5 * l_tax * 400), FALSE) AS rapid,
    CASE WHEN l_tax > 0.05 AND l_discount < 0.03 THEN CASE WHEN l_quantity > 40 THEN 'ANOMALY' ELSE 'WATCH' END WHEN l_quantity IS NULL THEN 'UNVERIFIED' ELSE 'NORMAL' END AS state FROM lineitem""")
def detectors(t: Tables) -> DataFrame:
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    loading = F.coalesce((x > 0.05) & (d < 0.03), F.lit(False))
    state = F.when(loading, F.when(q > 40, "ANOMALY").otherwise("WATCH")).when(q.isNull(), "UNVERIFIED").otherwise("NORMAL")
    return t.lineitem.select("l_orderkey", "l_linenumber", loading.alias("loading"), ((d > 0.05) & (x.isNull() | (x < 0.02))).alias("dry"), F.coalesce(q > F.greatest(F.lit(30.0), 1.5 * x * 400), F.lit(False)).alias("rapid"), state.alias("state"))


@query("q433_version_difference", "WITH a AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, sum(l_quantity) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS v FROM lineitem GROUP BY 1) SELECT round(max(abs(a.v - b.v)), 6) AS largest, count(*) FILTER (abs(a.v - b.v) > 1e-9) AS different FROM a JOIN b USING (l_suppkey)")
def versions(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    b = a.select("l_suppkey", (F.col("v") + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)).alias("w"))
    gap = F.abs(F.col("v") - F.col("w"))
    return a.join(b, "l_suppkey").agg(F.round(F.max(gap), 6).alias("largest"), F.count(F.when(gap > 1e-9, 1)).alias("different"))


@query("q437_bracketing_centres", "SELECT c_custkey, CASE WHEN abs(x / 0.25 - round(x / 0.25)) < 1e-9 THEN round(x / 0.25) * 0.25 ELSE floor(x / 0.25) * 0.25 END AS low, CASE WHEN abs(x / 0.25 - round(x / 0.25)) < 1e-9 THEN round(x / 0.25) * 0.25 ELSE floor(x / 0.25) * 0.25 END + 0.25 AS high FROM (SELECT c_custkey, (c_custkey * 37 % 1000) / 8.0 AS x FROM customer)")
def brackets(t: Tables) -> DataFrame:
    x = (F.col("c_custkey") * 37 % 1000) / 8.0
    near = F.round(x / 0.25)
    low = F.when(F.abs(x / 0.25 - near) < 1e-9, near * 0.25).otherwise(F.floor(x / 0.25) * 0.25)
    return t.customer.select("c_custkey", low.alias("low"), (low + 0.25).alias("high"))


@query("q441_distance_to_box", "SELECT c_custkey, round(111 * sqrt(pow(greatest(0, 10 - x, x - 20), 2) + pow(greatest(0, 30 - y, y - 50), 2)), 6) AS km, x BETWEEN 10 AND 20 AND y BETWEEN 30 AND 50 AS inside FROM (SELECT c_custkey, (c_custkey * 7 % 100) / 2.0 AS x, (c_custkey * 13 % 200) / 2.0 AS y FROM customer)")
def box_distance(t: Tables) -> DataFrame:
    x, y = (F.col("c_custkey") * 7 % 100) / 2.0, (F.col("c_custkey") * 13 % 200) / 2.0
    gap = lambda v, a, b: F.greatest(F.lit(0.0), a - v, v - b)
    return t.customer.select("c_custkey", F.round(111 * F.hypot(gap(x, 10, 20), gap(y, 30, 50)), 6).alias("km"), (x.between(10, 20) & y.between(30, 50)).alias("inside"))


@query("q446_train_standardize", "SELECT p_partkey, round((p_retailprice - avg(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END) OVER w) / nullif(stddev_samp(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END) OVER w, 0), 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def train_standardize(t: Tables) -> DataFrame:
    train = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice"))
    fit = t.part.groupBy("p_brand").agg(F.avg(train).alias("m"), F.stddev_samp(train).alias("s"))
    return t.part.join(fit, "p_brand").select("p_partkey", F.round((F.col("p_retailprice") - F.col("m")) / F.nullif("s", F.lit(0.0)), 6).alias("z"))


@query("q456_truth_coercion", "SELECT o_orderkey, CASE upper(trim(s)) WHEN '1' THEN 1 WHEN 'POSITIVE' THEN 1 WHEN 'TRUE' THEN 1 WHEN '0' THEN 0 WHEN 'NEGATIVE' THEN 0 WHEN 'FALSE' THEN 0 END AS truth FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' positive ' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'maybe' END AS s FROM orders)")
def truth(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    s = F.upper(F.trim(F.when(k == 0, " positive ").when(k == 1, "0").when(k == 2, "TRUE").when(k == 3, "maybe")))
    return t.orders.select("o_orderkey", F.when(s.isin("1", "POSITIVE", "TRUE"), 1).when(s.isin("0", "NEGATIVE", "FALSE"), 0).alias("truth"))


@query("q459_clamped_logit", "WITH x AS (SELECT doc_id, least(1 - 1e-6, greatest(1e-6, (doc_id % 101) / 100.0))::DOUBLE AS p FROM documents) SELECT doc_id, round(ln(p / (1 - p)), 8) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 8) AS back FROM x")
def logit(t: Tables) -> DataFrame:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("doc_id") % 101) / 100.0))
    z = F.ln(p / (1 - p))
    back = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return t.documents.select("doc_id", F.round(z, 8).alias("logit"), F.round(back, 8).alias("back"))


@query("q461_date_ranges_all", "SELECT o_orderkey, CAST(d AS DATE) AS day FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE)::TIMESTAMP, (CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 - 1 AS INT))::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM orders)")
def date_ranges_all(t: Tables) -> DataFrame:
    return expanded(t.orders)


def expanded(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.expr("date_add(o_orderdate, CAST(o_orderkey % 4 - 1 AS INT))").alias("b"))
    return o.filter("a <= b").select("o_orderkey", F.explode(F.sequence("a", "b")).alias("day"))


@query("q467_group_season", "SELECT user_id, coalesce(CASE WHEN month(min(ts)) IN (12, 1, 2) THEN 'DJF' WHEN month(min(ts)) IN (3, 4, 5) THEN 'MAM' WHEN month(min(ts)) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END, 'UNKNOWN') AS season, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS kinds FROM events GROUP BY 1")
def group_season(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.coalesce(X.season(F.min("ts")), F.lit("UNKNOWN")).alias("season"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


@query("q469_middle_element", "SELECT o_custkey, d[len(d) // 2 + 1] AS middle FROM (SELECT o_custkey, list_sort(list(DISTINCT CAST(o_orderdate AS DATE))) AS d FROM orders GROUP BY 1)")
def middle(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.to_date("o_orderdate"))).alias("d"))
    return d.select("o_custkey", F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("middle"))


@query("q473_worst_case_share", "WITH c AS (SELECT user_id % 10 AS grp, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS k, count(*) AS n FROM events GROUP BY 1, 2) SELECT grp, min_by(k, (k / n, day)) AS k, round(min(k / n), 10) AS share, min_by(day, (k / n, day)) AS day FROM c GROUP BY 1")
def worst_case(t: Tables) -> DataFrame:
    c = t.events.groupBy((F.col("user_id") % 10).alias("grp"), F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("k"), F.count(F.lit(1)).alias("n")).withColumn("s", F.col("k") / F.col("n"))
    return c.groupBy("grp").agg(F.min_by("k", F.struct("s", "day")).alias("k"), F.round(F.min("s"), 10).alias("share"), F.min_by("day", F.struct("s", "day")).alias("day"))


@query("q490_volume_factor", "SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN u LIKE '%km3%' THEN 1e9 WHEN u LIKE '%million%' THEN 1e6 WHEN u LIKE '%m3%' THEN 1 ELSE 1e6 END AS volume, u NOT LIKE '%km3%' AND u NOT LIKE '%million%' AND u NOT LIKE '%m3%' AS assumed FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'km3' WHEN 1 THEN 'million m3' WHEN 2 THEN 'm3' ELSE 'unknown' END AS u FROM lineitem)")
def volume_factor(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 4
    u = F.when(k == 0, "km3").when(k == 1, "million m3").when(k == 2, "m3").otherwise("unknown")
    factor = F.when(u.contains("km3"), 1e9).when(u.contains("million"), 1e6).when(u.contains("m3"), 1.0).otherwise(1e6)
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * factor).alias("volume"), (~u.contains("m3") & ~u.contains("million")).alias("assumed"))


@query("q491_scalar_parse", "SELECT o_orderkey, CASE WHEN v >= 0 THEN v END AS value FROM (SELECT o_orderkey, TRY_CAST(replace(trim(s), ',', '') AS DOUBLE) AS v FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' 1,234.5 ' WHEN 1 THEN '-7' WHEN 2 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS s FROM orders))")
def scalar_parse(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, " 1,234.5 ").when(k == 1, "-7").when(k == 2, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    v = F.replace(F.trim(s), F.lit(","), F.lit("")).try_cast("double")
    return t.orders.select("o_orderkey", F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v).alias("value"))


@query("q497_edge_mask", "SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('f', 'true', '1', 'yes') AND month(o_orderdate) = 6 AND day(o_orderdate) <= 6 AS edge FROM orders")
def edge_mask(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", (F.coalesce(F.lower(F.trim("o_orderstatus")).isin("f", "true", "1", "yes"), F.lit(False)) & (F.month(d) == 6) & (F.dayofmonth(d) <= 6)).alias("edge"))


@query("q431_month_reference", f"WITH {UNIT_SQL} SELECT unit, CAST(month(day) AS INT) AS month, count(v) AS n, round(avg(v), 6) AS mean_value, CASE WHEN count(v) >= 30 AND stddev_pop(v) > 0 THEN round(stddev_pop(v), 6) END AS spread FROM unit_daily GROUP BY 1, 2")
def month_reference(t: Tables) -> DataFrame:
    s = F.stddev_pop("v")
    return unit_daily(t).groupBy("unit", F.month("day").alias("month")).agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean_value"), F.when((F.count("v") >= 30) & (s > 0), F.round(s, 6)).alias("spread"))


@query("q444_adjacent_months", "WITH m AS (SELECT DISTINCT o_custkey AS box, (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS k FROM orders) SELECT a.box, CAST((a.k - 1) // 12 AS INT) AS year, CAST((a.k - 1) % 12 + 1 AS INT) AS month FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.box = a.box AND b.k = a.k - 1) AND a.k % 12 <> 0")
def adjacent_months(t: Tables) -> DataFrame:
    m = t.orders.select(F.col("o_custkey").alias("box"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("k")).distinct()
    want = m.filter("k % 12 <> 0").select("box", (F.col("k") - 1).alias("k"))
    return want.join(m, ["box", "k"], "left_anti").select("box", F.floor(F.col("k") / 12).cast("int").alias("year"), (F.col("k") % 12 + 1).cast("int").alias("month"))


@query("q481_cluster_key", "SELECT doc_id, CASE WHEN trim(coalesce(source, '')) <> '' AND doc_id % 3 = 0 THEN source ELSE lang || '|' || CAST(doc_id % 4 AS VARCHAR) END AS cluster FROM documents")
def cluster_key(t: Tables) -> DataFrame:
    known = (F.trim(F.coalesce("source", F.lit(""))) != "") & (F.col("doc_id") % 3 == 0)
    return t.documents.select("doc_id", F.when(known, F.col("source")).otherwise(F.concat_ws("|", "lang", (F.col("doc_id") % 4).cast("string"))).alias("cluster"))
