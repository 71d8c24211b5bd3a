"""Queries on panel intake, requests and calendars (inventory 2.1, 2.9b, 2.9c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import intake as I
from panelforge.plans.panels import UNIT_SQL, unit_daily
from panelforge.plans.registry import Tables, query

HOURLY = "h AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, avg(value) AS v FROM events GROUP BY 1, 2, 3)"


def hourly(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.avg("value").alias("v"))


@query("q142_daily_means", "SELECT user_id, ts::DATE AS day, round(avg(value), 8) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def daily(t: Tables) -> DataFrame:
    return I.daily_means(t.events, "user_id", "ts", ["value"]).withColumn("value", F.round("value", 8))


@query("q347_coalesced_members", f"WITH {HOURLY} SELECT user_id, hour::DATE AS day, hour(hour)::INT AS hr, round(max(v) FILTER (event_type = 'click'), 8) AS click, round(max(v) FILTER (event_type = 'view'), 8) AS view, greatest(count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'view'), 0) AS sources, count(DISTINCT event_type) AS members FROM h GROUP BY 1, 2, 3")
def members(t: Tables) -> DataFrame:
    """Members that hold one variable each, merged on their time axis."""
    m = hourly(t).select("user_id", F.to_date("hour").alias("day"), F.hour("hour").alias("hr"), "event_type", F.when(F.col("event_type") == "click", F.col("v")).alias("click"), F.when(F.col("event_type") == "view", F.col("v")).alias("view"))
    return I.coalesced(m, ["user_id", "day", "hr"], "event_type", ["click", "view"]).withColumns({c: F.round(c, 8) for c in ("click", "view")})


@query("q348_cell_series", "SELECT ts::DATE AS day, hour(ts)::INT AS hr, round(avg(value), 8) AS value FROM events GROUP BY 1, 2")
def cell_series(t: Tables) -> DataFrame:
    """Cell rows with epoch milliseconds as one mean a time."""
    cells = t.events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")
    at = F.timestamp_millis("ms")
    return I.box_means(cells.select(F.to_date(at).alias("day"), F.hour(at).alias("hr"), "value"), ["day", "hr"], ["value"]).withColumn("value", F.round("value", 8))


@query("q349_joined_hourly", "WITH a AS (SELECT ts::DATE AS day, hour(ts)::INT AS hr, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT ts::DATE AS day, hour(ts)::INT AS hr, avg(value) AS y FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT day, count(*) AS n, count(*) FILTER (x IS NULL OR y IS NULL) AS gaps, round(sum(x - y), 6) AS diff FROM a JOIN b USING (day, hr) WHERE month(day) IN (1, 2) GROUP BY 1")
def joined(t: Tables) -> DataFrame:
    one = lambda kind, name: t.events.filter(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hr")).agg(F.avg("value").alias(name))
    both = I.joined_hourly(one("click", "x"), one("view", "y"), ["day", "hr"], [1, 2], "day")
    return both.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("gaps"), F.round(F.sum(F.col("x") - F.col("y")), 6).alias("diff"))


@query("q350_daily_frame", "SELECT user_id, ts::DATE AS day, round(avg(value - 273.15), 6) AS celsius, round(sum(greatest(value, 0)), 6) AS total, round(greatest(avg(value) - 5, 0), 6) AS degree_days FROM events GROUP BY 1, 2")
def daily_frame(t: Tables) -> DataFrame:
    """Hourly rows as daily features: a converted mean, an accumulation, positive degree days."""
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"), F.avg(F.col("value") - 273.15).alias("celsius"), F.sum(F.greatest("value", F.lit(0.0))).alias("total"))
    return d.select("user_id", "day", F.round("celsius", 6).alias("celsius"), F.round("total", 6).alias("total"), F.round(F.greatest(F.col("m") - 5, F.lit(0.0)), 6).alias("degree_days"))


@query("q351_panel", f"WITH {UNIT_SQL} SELECT unit, day, v, unit AS basin_group, 'JJA' AS season, CASE WHEN year(day) < 2013 THEN 'pre_2013' ELSE 'post_2013' END AS era, CASE unit WHEN 'A' THEN 3000.0 WHEN 'N' THEN 4000.0 ELSE 5000.0 END::DOUBLE AS elevation_m FROM unit_daily WHERE month(day) IN (6, 7, 8)")
def panels(t: Tables) -> DataFrame:
    u = unit_daily(t).filter(F.month("day").isin(6, 7, 8))
    return I.panel(u, "unit", "day", F.when(F.col("unit") == "A", 3000.0).when(F.col("unit") == "N", 4000.0).otherwise(5000.0))


@query("q355_computable_windows", f"WITH {UNIT_SQL}, m AS (SELECT a.unit, a.day FROM unit_daily a JOIN unit_daily b ON a.unit = b.unit AND b.day IN (a.day - 1, a.day - 2, a.day - 7) GROUP BY 1, 2 HAVING count(*) = 3) SELECT u.unit, count(*) AS n, count(m.day) AS n_ref FROM unit_daily u LEFT JOIN m ON u.unit = m.unit AND u.day = m.day GROUP BY 1")
def computable(t: Tables) -> DataFrame:
    return I.computable(unit_daily(t), "unit", "day", [1, 2, 7])


@query("q377_grid_axis", "SELECT n_nationkey, i::INT AS nth, round(n_nationkey + 0.25 * i, 6)::DOUBLE AS lat FROM nation, range(5) r(i)")
def axis(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.round(F.col("n_nationkey") + 0.25 * i, 6).cast("double"))).alias("nth", "lat"))


@query("q378_mean_without_nulls", "SELECT user_id, CASE WHEN count(*) FILTER (value > 60) = 0 THEN round(avg(value), 8) END AS value FROM events GROUP BY 1")
def whole_means(t: Tables) -> DataFrame:
    cells = t.events.select("user_id", F.when(F.col("value") <= 60, F.col("value")).alias("value"))
    return I.mean_without_nulls(cells, ["user_id"], "value").withColumn("value", F.round("value", 8))


@query("q427_merged_selections", "SELECT user_id, ts::DATE AS day, round(arg_min(value, event_id), 8) AS value, count(DISTINCT value) AS different FROM events GROUP BY 1, 2")
def selections(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return I.merged_selections(rows, ["user_id", "day"], "event_id", "value").withColumn("value", F.round("value", 8))


@query("q309_components", f"WITH {HOURLY}, w AS (SELECT user_id, hour::DATE AS day, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'view') AS view FROM h GROUP BY 1, 2) SELECT user_id, day, round(click, 8) AS click, round(view, 8) AS view, click IS NOT NULL AND view IS NOT NULL AS complete FROM w")
def components(t: Tables) -> DataFrame:
    h = hourly(t).withColumn("day", F.to_date("hour"))
    return I.components_merged(h, ["user_id", "day"], "event_type", ["click", "view"], "v").withColumns({c: F.round(c, 8) for c in ("click", "view")})


@query("q426_masked_daily", "WITH d AS (SELECT user_id, ts::DATE AS day, avg(value) AS v, avg(CASE WHEN value < 20 THEN 20 - value END) AS deficit, count(*) FILTER (value < 20) / count(*) AS valid FROM events GROUP BY 1, 2) SELECT user_id, day, round(v, 8) AS v, round(deficit, 8) AS deficit, round(valid, 8) AS valid FROM d")
def masked(t: Tables) -> DataFrame:
    """Daily means with a deficit over the cells under the mask alone, and the share of those."""
    low = F.col("value") < 20
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 8).alias("v"), F.round(F.avg(F.when(low, 20 - F.col("value"))), 8).alias("deficit"), F.round(F.count(F.when(low, 1)) / F.count(F.lit(1)), 8).alias("valid"))


@query("q435_reindexed_daily", f"WITH {UNIT_SQL}, c AS (SELECT unit, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM unit_daily GROUP BY 1) SELECT c.unit, c.day, round(v, 4) AS v FROM c LEFT JOIN unit_daily u ON c.unit = u.unit AND c.day = u.day")
def reindexed(t: Tables) -> DataFrame:
    u = unit_daily(t)
    c = u.groupBy("unit").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("unit", F.explode(F.sequence("a", "b")).alias("day"))
    return c.join(u, ["unit", "day"], "left").select("unit", "day", F.round("v", 4).alias("v"))


@query("q449_request_days", "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders) SELECT m, d::DATE AS day FROM (SELECT m, unnest(generate_series(m::TIMESTAMP, least(last_day(m), DATE '2000-05-17')::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM m WHERE m <= DATE '2000-05-17')")
def days(t: Tables) -> DataFrame:
    return I.request_days(t.orders.select(F.trunc("o_orderdate", "month").alias("m")).distinct(), "m", "2000-05-17")


@query("q450_request_months", "SELECT DISTINCT year(o_orderdate)::INT AS year, k::INT AS month FROM orders, (SELECT unnest([6, 7, 8]) AS k) WHERE year(o_orderdate) <= 2000")
def months(t: Tables) -> DataFrame:
    return t.orders.select(F.year("o_orderdate").alias("year")).distinct().filter("year <= 2000").withColumn("month", F.explode(F.array(F.lit(6), F.lit(7), F.lit(8))))


@query("q399_season_hours", "SELECT y AS year, count(*) AS hours, count(*) FILTER (month(h) = 7) AS july FROM (SELECT y, unnest(generate_series(make_timestamp(y, 6, 1, 0, 0, 0), make_timestamp(y, 8, 31, 23, 0, 0), INTERVAL 1 HOUR)) AS h FROM (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders)) GROUP BY 1")
def season_hours(t: Tables) -> DataFrame:
    at = lambda *p: F.make_timestamp(F.col("year"), *map(F.lit, p))
    y = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    h = y.select("year", F.explode(F.sequence(at(6, 1, 0, 0, 0), at(8, 31, 23, 0, 0), F.expr("INTERVAL 1 HOUR"))).alias("h"))
    return h.groupBy("year").agg(F.count(F.lit(1)).alias("hours"), F.count(F.when(F.month("h") == 7, 1)).alias("july"))


@query("q324_request_groups", "WITH w AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, list_sort(list(DISTINCT day(o_orderdate))) AS d FROM orders GROUP BY 1, 2) SELECT month, array_to_string(d, ',') AS days, len(d)::INT AS n_days, count(*) AS sites FROM w GROUP BY 1, 2, 3")
def groups(t: Tables) -> DataFrame:
    return I.request_groups(t.orders, "o_custkey", "o_orderdate")


@query("q196_month_outcomes", f"WITH {UNIT_SQL} SELECT a.unit, month(a.day)::INT AS month, count(*) AS n, round(avg(b.v), 6) AS mean FROM unit_daily a JOIN unit_daily b ON a.unit = b.unit AND b.day = a.day + 5 GROUP BY 1, 2")
def outcomes(t: Tables) -> DataFrame:
    return I.month_outcomes(unit_daily(t), "unit", "day", "v", 5).withColumn("mean", F.round("mean", 6))


@query("q189_event_score", f"WITH {UNIT_SQL}, r AS (SELECT unit, day, CASE WHEN count(v) OVER w = 7 THEN sum(v) OVER w END AS s FROM unit_daily WINDOW w AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)), u AS (SELECT unit, month(day) AS m, avg(s) AS a, stddev_samp(s) AS sd FROM r GROUP BY 1, 2) SELECT r.unit, r.day, CASE WHEN sd > 0 THEN round((s - a) / sd, 6) END AS z FROM r JOIN u ON r.unit = u.unit AND month(r.day) = u.m")
def event_scores(t: Tables) -> DataFrame:
    return I.event_score(unit_daily(t), "unit", "day", "v", 7).select("unit", "day", F.round("z", 6).alias("z"))


@query("q494_dense_grid", "SELECT g.r::INT AS row, c.c::INT AS col, max(p_retailprice) AS value FROM range(10) g(r) CROSS JOIN range(10) c(c) LEFT JOIN part ON p_size // 10 = g.r AND p_size % 10 = c.c GROUP BY 1, 2")
def grid(t: Tables) -> DataFrame:
    v = t.part.groupBy(F.floor(F.col("p_size") / 10).cast("int").alias("row"), (F.col("p_size") % 10).alias("col")).agg(F.max("p_retailprice").alias("value"))
    return I.dense_grid(v, 10, 10, "row", "col", "value")


#: Rasters by brand; every fifth is in another system, every third lies off by half a cell, every seventh has a row more.
_N20 = "CAST(substr(p_brand, 7) AS INT)"


@query("q20_aligned_raster", f"""WITH m AS (SELECT DISTINCT p_brand AS raster, {_N20} AS k FROM part), p AS (SELECT raster, list_filter([CASE WHEN k % 5 = 0 THEN 'crs' END, CASE WHEN k % 7 = 0 THEN 'shape' END, CASE WHEN k % 3 = 0 THEN 'transform' END], lambda x: x IS NOT NULL) AS problems FROM m)
    SELECT raster, array_to_string(problems, ',') AS problems, count(p_partkey) FILTER (len(problems) = 0) AS cells, count(CASE WHEN p_size <> 7 THEN p_retailprice END) FILTER (len(problems) = 0) AS with_value, round(sum(CASE WHEN p_size <> 7 THEN p_retailprice END) FILTER (len(problems) = 0), 4) AS total FROM p JOIN part ON p_brand = raster GROUP BY 1, 2""")
def raster(t: Tables) -> DataFrame:
    """Rasters read only if system, shape and transform are exactly the target's, their no-data value as null."""
    target = I.Grid("EPSG:32645", 300, 300, (90.0, 0.0, 250000.0, 0.0, -90.0, 3100000.0))
    k = F.substring("p_brand", 7, 8).cast("int")
    cells = t.part.select(F.col("p_brand").alias("raster"), "p_partkey", F.when(F.col("p_size") == 7, -9999.0).otherwise(F.col("p_retailprice")).alias("value"))
    meta = t.part.select(F.col("p_brand").alias("raster"), F.when(k % 5 == 0, "EPSG:4326").otherwise("EPSG:32645").alias("crs"), F.when(k % 7 == 0, 301).otherwise(300).alias("rows"), F.lit(300).alias("cols"),
                         F.array(F.lit(90.0), F.lit(0.0), F.when(k % 3 == 0, 250045.0).otherwise(250000.0), F.lit(0.0), F.lit(-90.0), F.lit(3100000.0)).alias("transform"), F.lit(-9999.0).alias("nodata")).distinct()
    read = I.aligned(cells, meta, target)
    return read.groupBy("raster", F.array_join("problems", ",").alias("problems")).agg(F.count("p_partkey").alias("cells"), F.count("value").alias("with_value"), F.round(F.sum("value"), 4).alias("total"))


@query("q25_member_digests", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'undeclared' WHEN p_partkey % 5 = 1 THEN 'differs' ELSE 'same' END AS status FROM part")
def digests(t: Tables) -> DataFrame:
    """Live digests of contents against those declared for them."""
    live = t.part.select("p_partkey", F.sha2(F.col("p_name").cast("binary"), 256).alias("live"))
    k = F.col("p_partkey") % 5
    declared = t.part.filter(k != 0).select("p_partkey", F.sha2(F.concat("p_name", F.when(k == 1, "!").otherwise("")).cast("binary"), 256).alias("declared"))
    status = F.when(F.col("declared").isNull(), "undeclared").when(F.col("declared") == F.col("live"), "same").otherwise("differs")
    return live.join(declared, "p_partkey", "left").select("p_partkey", status.alias("status"))


@query("q455_files_along_time", "SELECT l_returnflag AS file, count(*) AS n, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day FROM lineitem GROUP BY 1")
def along_time(t: Tables) -> DataFrame:
    """Files concatenated as they are, no row dropped; the order along time is a range exchange, not one sort."""
    files = [t.lineitem.filter(F.col("l_returnflag") == f).withColumn("file", F.lit(f)) for f in ("A", "N", "R")]
    rows = files[0].unionByName(files[1]).unionByName(files[2]).orderBy("l_shipdate")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))
