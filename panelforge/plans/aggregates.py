"""Queries on further aggregates, windows, sets and tests (inventory 2.4 to 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import windows as W
from panelforge.operators.grids import candidate_order
from panelforge.plans.panels import DAILY_SQL, EVENT_SQL, UNIT_SQL, daily_orders, event_days, unit_daily
from panelforge.plans.registry import Tables, query


@query("q145_share_beyond", f"WITH {UNIT_SQL} SELECT unit, threshold, round(avg((v >= threshold)::INT), 8) AS share FROM unit_daily CROSS JOIN (VALUES (100.0::DOUBLE), (150.0::DOUBLE), (200.0::DOUBLE), (300.0::DOUBLE)) x(threshold) GROUP BY 1, 2")
def share_beyond(t: Tables) -> DataFrame:
    w = unit_daily(t).withColumn("threshold", F.explode(F.array(*map(F.lit, (100.0, 150.0, 200.0, 300.0)))))
    return w.groupBy("unit", "threshold").agg(F.round(F.avg((F.col("v") >= F.col("threshold")).cast("int")), 8).alias("share"))


@query("q147_gate_checks", "SELECT count(*) >= 100 AS enough, bool_and(o_totalprice > 0) AS positive, count(DISTINCT o_orderstatus) >= 2 AS varied, count(*) FILTER (o_orderdate IS NULL) = 0 AS dated FROM orders")
def gate_checks(t: Tables) -> DataFrame:
    return t.orders.agg((F.count(F.lit(1)) >= 100).alias("enough"), F.bool_and(F.col("o_totalprice") > 0).alias("positive"), (F.count_distinct("o_orderstatus") >= 2).alias("varied"), (F.count(F.when(F.col("o_orderdate").isNull(), 1)) == 0).alias("dated"))


@query("q148_reason_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 400000 THEN 'large' END) FILTER (o_totalprice < 50000 OR o_orderstatus = 'P' OR o_totalprice > 400000)), '|') AS reasons FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice < 50000 OR o_orderstatus = 'P' OR o_totalprice > 400000) > 0")
def reason_lists(t: Tables) -> DataFrame:
    r = F.when(F.col("o_totalprice") < 50000, "small").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") > 400000, "large")
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(r)).alias("r"))
    return g.filter(F.size("r") > 0).select("o_custkey", F.array_join("r", "|").alias("reasons"))


@query("q151_occupancy_all", "WITH c AS (SELECT p_size % 7 AS label, count(*) AS n FROM part GROUP BY 1) SELECT CAST(l AS INT) AS label, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 10) AS share FROM range(9) r(l) LEFT JOIN c ON label = l")
def occupancy_all(t: Tables) -> DataFrame:
    """Labels 7 and 8 are in the spine and occur nowhere."""
    return occupied(t, t.part, 9)


def occupied(t: Tables, part: DataFrame, labels: int) -> DataFrame:
    c = part.groupBy((F.col("p_size") % 7).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    spine = t.spark.range(labels).select(F.col("id").cast("int").alias("label"))
    return spine.join(c, "label", "left").join(F.broadcast(total)).select("label", F.round(F.coalesce("n", F.lit(0)) / F.col("all"), 10).alias("share"))


@query("q171_distinct_denominators", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS units, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS verified, count(DISTINCT o_custkey::VARCHAR || '-' || year(o_orderdate)::VARCHAR) AS unit_years FROM orders GROUP BY 1")
def denominators(t: Tables) -> DataFrame:
    unit_year = F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"))
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("units"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("verified"), F.count_distinct(unit_year).alias("unit_years"))


@query("q178_partition_check", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def partition_check(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("groups")).filter("groups > 1")


@query("q195_reference_state", f"WITH {UNIT_SQL}, m AS (SELECT unit, month(day) AS m, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS s FROM unit_daily GROUP BY 1, 2) SELECT u.unit, day, CASE WHEN n >= 30 AND s > 0 THEN round((v - mean) / s, 6) END AS z, CASE WHEN n < 30 THEN 'few' WHEN s = 0 THEN 'flat' ELSE 'ok' END AS reason FROM unit_daily u JOIN m ON u.unit = m.unit AND month(day) = m.m WHERE year(day) = 2000")
def reference_state(t: Tables) -> DataFrame:
    u = unit_daily(t).withColumn("m", F.month("day"))
    ref = u.groupBy("unit", "m").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("s"))
    j = u.filter(F.year("day") == 2000).join(F.broadcast(ref), ["unit", "m"])
    reason = F.when(F.col("n") < 30, "few").when(F.col("s") == 0, "flat").otherwise("ok")
    return j.select("unit", "day", F.when(reason == "ok", F.round((F.col("v") - F.col("mean")) / F.col("s"), 6)).alias("z"), reason.alias("reason"))


@query("q197_washout_all", f"WITH {UNIT_SQL}, {EVENT_SQL} SELECT u.unit, count(*) AS kept FROM unit_daily u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.unit = u.unit AND u.day BETWEEN e.event_day - 7 AND e.event_day + 7) GROUP BY 1")
def washout_all(t: Tables) -> DataFrame:
    return washed(t, event_days(t).withColumnRenamed("event_day", "d"))


def washed(t: Tables, e: DataFrame) -> DataFrame:
    near = e.select("unit", F.explode(F.sequence(F.date_sub("d", 7), F.date_add("d", 7))).alias("day")).distinct()
    return unit_daily(t).join(near, ["unit", "day"], "left_anti").groupBy("unit").agg(F.count(F.lit(1)).alias("kept"))


@query("q200_circular_distance", f"WITH {DAILY_SQL} SELECT day, CAST(least(abs(dayofyear(day) - 360), 366 - abs(dayofyear(day) - 360)) AS INT) AS away FROM daily")
def circular(t: Tables) -> DataFrame:
    d = F.abs(F.dayofyear("day") - 360)
    return daily_orders(t).select("day", F.least(d, 366 - d).alias("away"))


@query("q203_run_ids", f"WITH {UNIT_SQL}, l AS (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY unit ORDER BY day) <> 1)::INT, 1) AS gap FROM unit_daily), r AS (SELECT unit, day, sum(gap) OVER (PARTITION BY unit ORDER BY day) AS run FROM l) SELECT unit, CAST(run AS BIGINT) AS run, min(day) AS first_day, count(*) AS days FROM r GROUP BY 1, 2")
def run_ids(t: Tables) -> DataFrame:
    r = W.with_runs(unit_daily(t), ["unit"], "day", "run")
    return r.groupBy("unit", "run").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"))


@query("q209_median_split", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), m AS (SELECT user_id, quantile_disc(day, 0.5) AS mid FROM d GROUP BY 1) SELECT user_id, count(*) FILTER (day <= mid) AS early, count(*) FILTER (day > mid) AS late FROM d JOIN m USING (user_id) GROUP BY 1")
def median_split(t: Tables) -> DataFrame:
    d = t.events.select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).distinct()
    m = d.groupBy("user_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY day)").alias("mid"))
    return d.join(m, "user_id").groupBy("user_id").agg(F.count(F.when(F.col("day") <= F.col("mid"), 1)).alias("early"), F.count(F.when(F.col("day") > F.col("mid"), 1)).alias("late"))


@query("q212_latency", "SELECT event_id, round((epoch(ts) - epoch(date_trunc('day', ts))) / 3600, 6) AS hours, epoch(ts) - epoch(date_trunc('day', ts)) > 43200 AS late FROM events")
def latency(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_timestamp(F.date_trunc("day", "ts"))
    return t.events.select("event_id", F.round(s / 3600, 6).alias("hours"), (s > 43200).alias("late"))


@query("q218_five_key_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey % 13 DESC, p_partkey) AS place FROM part QUALIFY place <= 50")
def five_keys(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 13).cast("double").alias("c"))
    top = p.orderBy(*candidate_order("p_partkey", "a", "b", "c")).limit(50)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(*candidate_order("p_partkey", "a", "b", "c"))).cast("long").alias("place"))


@query("q235_declared_and_observed", "SELECT year(o_orderdate)::INT AS era, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN 'declared' ELSE 'undeclared' END AS state, count(*) AS n FROM orders GROUP BY 1, 2")
def eras(t: Tables) -> DataFrame:
    declared = t.spark.range(1996, 2001).select(F.col("id").cast("int").alias("era"), F.lit("declared").alias("state"))
    n = t.orders.groupBy(F.year("o_orderdate").alias("era")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(declared), "era", "left").select("era", F.coalesce("state", F.lit("undeclared")).alias("state"), "n")


@query("q239_graph_checks", "WITH e AS (SELECT c_custkey AS id, (c_custkey * 7) % 2000 AS parent FROM customer) SELECT count(*) FILTER (id = parent) AS self_parent, count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.parent)) AS dangling FROM e")
def graph_checks(t: Tables) -> DataFrame:
    e = t.customer.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7) % 2000).alias("parent"))
    known = t.customer.select(F.col("c_custkey").alias("parent"), F.lit(True).alias("known"))
    return e.join(known, "parent", "left").agg(F.count(F.when(F.col("id") == F.col("parent"), 1)).alias("self_parent"), F.count(F.when(F.col("known").isNull(), 1)).alias("dangling"))


@query("q287_case_crossover_all", f"WITH {UNIT_SQL}, {EVENT_SQL} SELECT e.unit, event_day, count(*) AS controls, round(avg(v), 6) AS control_mean FROM e JOIN unit_daily u ON u.unit = e.unit AND month(u.day) = month(event_day) AND year(u.day) <> year(event_day) GROUP BY 1, 2")
def crossover_all(t: Tables) -> DataFrame:
    return crossed(t, event_days(t))


def crossed(t: Tables, e: DataFrame) -> DataFrame:
    """Controls are summed by unit, month and year first; an event takes its month's sums less its own year's."""
    m = unit_daily(t).groupBy("unit", F.month("day").alias("m"), F.year("day").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    j = e.join(F.broadcast(m), (e.unit == m.unit) & (F.month("event_day") == F.col("m")) & (F.year("event_day") != F.col("y"))).drop(m.unit)
    return j.groupBy("unit", "event_day").agg(F.sum("n").alias("controls"), F.round(F.sum("s") / F.sum("n"), 6).alias("control_mean"))


@query("q290_parity_partition", f"WITH {UNIT_SQL} SELECT unit, CAST((ascii(unit) + (day - DATE '1970-01-01')) % 2 AS INT) AS part, count(*) AS n, round(avg(v), 6) AS mean_value FROM unit_daily GROUP BY 1, 2")
def parity(t: Tables) -> DataFrame:
    part = (F.ascii("unit") + F.datediff("day", F.lit("1970-01-01"))) % 2
    return unit_daily(t).groupBy("unit", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_value"))


@query("q297_rule_baseline", "SELECT l_orderkey, l_linenumber, round(least(l_discount / 0.1, l_tax / 0.08, l_quantity / 50), 8) AS p FROM lineitem")
def rule_baseline(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.least(F.col("l_discount") / 0.1, F.col("l_tax") / 0.08, F.col("l_quantity") / 50), 8).alias("p"))


@query("q302_power_report", "SELECT lang, count(DISTINCT source) AS clusters, CAST(ceil(1.96 * 1.96 * 0.25 / (0.1 * 0.1)) AS BIGINT) AS needed, count(DISTINCT source) >= ceil(1.96 * 1.96 * 0.25 / (0.1 * 0.1)) AS enough FROM documents GROUP BY 1")
def power_report(t: Tables) -> DataFrame:
    need = F.ceil(F.lit(1.96 * 1.96 * 0.25 / (0.1 * 0.1)))
    n = F.count_distinct("source")
    return t.documents.groupBy("lang").agg(n.alias("clusters"), F.max(need).alias("needed"), (n >= F.max(need)).alias("enough"))


@query("q313_rank_like", "SELECT p_brand, count(DISTINCT p_size) >= 3 AND count(DISTINCT p_size) = max(p_size) - min(p_size) + 1 AS rank_like FROM part GROUP BY 1")
def rank_like(t: Tables) -> DataFrame:
    n = F.count_distinct("p_size")
    return t.part.groupBy("p_brand").agg(((n >= 3) & (n == F.max("p_size") - F.min("p_size") + 1)).alias("rank_like"))


@query("q314_same_order", "WITH l AS (SELECT p_brand, p_size, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS before FROM part) SELECT p_brand, coalesce(bool_and(p_size >= before), TRUE) AS monotone FROM l GROUP BY 1")
def same_order(t: Tables) -> DataFrame:
    l = t.part.withColumn("before", F.lag("p_size").over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")))
    return l.groupBy("p_brand").agg(F.coalesce(F.bool_and(F.col("p_size") >= F.col("before")), F.lit(True)).alias("monotone"))
