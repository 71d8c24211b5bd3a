"""Queries on further derivations and record rules (inventory 2.2, 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as X
from panelforge.plans.registry import Tables, query


@query("q38_units", "SELECT l_orderkey, l_linenumber, round(l_quantity + 250 - 273.15, 6) AS celsius, round(l_tax * 1000, 6) AS millimetres FROM lineitem")
def units(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(X.kelvin_to_celsius(F.col("l_quantity") + 250), 6).alias("celsius"), F.round(F.col("l_tax") * 1000, 6).alias("millimetres"))


@query("q46_cutoff_violations", "SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '2001-06-01') AS late, count(*) AS n FROM orders")
def cutoff(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.when(F.col("o_orderdate") >= "2001-06-01", 1)).alias("late"), F.count(F.lit(1)).alias("n"))


@query("q50_before_event", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-15T00:00:00' AS before FROM events")
def before_event(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss") < "2024-01-15T00:00:00").alias("before"))


@query("q51_month_names", "SELECT o_orderkey, CASE lower(trim(s)) WHEN 'january' THEN 1 WHEN 'july' THEN 7 WHEN 'autumn' THEN 10 END AS month FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' January ' WHEN 1 THEN 'july' WHEN 2 THEN 'Autumn' ELSE 'never' END AS s FROM orders)")
def month_names(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = F.lower(F.trim(F.when(k == 0, " January ").when(k == 1, "july").when(k == 2, "Autumn").otherwise("never")))
    return t.orders.select("o_orderkey", F.when(s == "january", 1).when(s == "july", 7).when(s == "autumn", 10).alias("month"))


@query("q53_finite_guard", "SELECT event_id, CASE WHEN v IS NOT NULL AND NOT isnan(v) AND abs(v) < 'inf'::DOUBLE THEN v END AS seconds FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS v FROM events)")
def finite(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value"))
    return t.events.select("event_id", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("seconds"))


@query("q55_timing_class", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'coarse' WHEN l_quantity <= 1 THEN 'day' WHEN l_quantity <= 7 THEN 'week' WHEN l_quantity <= 31 THEN 'month' ELSE 'coarse' END AS class FROM lineitem")
def timing(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "coarse").when(q <= 1, "day").when(q <= 7, "week").when(q <= 31, "month").otherwise("coarse").alias("class"))


@query("q56_eligible_horizons", "SELECT event_id, array_to_string(list_transform(list_filter([6, 24, 72, 240, 720], lambda h: h * 3600 >= w), lambda h: h::VARCHAR), ',') AS horizons FROM (SELECT event_id, (event_id * 7907) % 3000000 AS w FROM events)")
def horizons(t: Tables) -> DataFrame:
    e = t.events.select("event_id", ((F.col("event_id") * 7907) % 3000000).alias("w"))
    ok = F.filter(F.array(*map(F.lit, (6, 24, 72, 240, 720))), lambda h: h * 3600 >= F.col("w"))
    return e.select("event_id", F.array_join(F.transform(ok, lambda h: h.cast("string")), ",").alias("horizons"))


@query("q67_coordinate_precision", "SELECT c_custkey, length(rtrim(split_part(printf('%.4f', x), '.', 2), '0')) AS decimals FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 27.5 WHEN 1 THEN 27.25 ELSE 27.1234 END AS x FROM customer)")
def coordinate_precision(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    x = F.when(k == 0, 27.5).when(k == 1, 27.25).otherwise(27.1234)
    return t.customer.select("c_custkey", X.decimals(x).cast("long").alias("decimals"))


@query("q68_split_list", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(s, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM (SELECT p_partkey, p_brand || ' ; ;' || p_type || ';' AS s FROM part)")
def split_list(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(X.split_list(F.concat("p_brand", F.lit(" ; ;"), "p_type", F.lit(";"))), "|").alias("parts"))


@query("q72_decision_table", "SELECT doc_id, CASE WHEN contains(lower(text), 'licensed') THEN 'licensed' WHEN contains(lower(text), 'rights') THEN 'reserved' WHEN contains(text, '|') THEN 'table' ELSE 'other' END AS stratum FROM documents")
def decision_table(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", F.when(low.contains("licensed"), "licensed").when(low.contains("rights"), "reserved").when(F.col("text").contains("|"), "table").otherwise("other").alias("stratum"))


@query("q74_partial_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN make_date(y, m, d) WHEN o_orderkey % 3 = 1 THEN make_date(y, m, 1) ELSE make_date(y, 1, 1) END AS first_day, CASE WHEN o_orderkey % 3 = 0 THEN make_date(y, m, d) WHEN o_orderkey % 3 = 1 THEN last_day(make_date(y, m, 1)) ELSE make_date(y, 12, 31) END AS last_day FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)")
def partial_dates(t: Tables) -> DataFrame:
    y, m, d, k = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.col("o_orderkey") % 3
    exact, month = F.make_date(y, m, d), F.make_date(y, m, F.lit(1))
    return t.orders.select("o_orderkey", F.when(k == 0, exact).when(k == 1, month).otherwise(F.make_date(y, F.lit(1), F.lit(1))).alias("first_day"), F.when(k == 0, exact).when(k == 1, F.last_day(month)).otherwise(F.make_date(y, F.lit(12), F.lit(31))).alias("last_day"))


@query("q76_lookup_with_ledger", "SELECT s_suppkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS basin, CASE WHEN n_nationkey % 5 = 0 THEN 'unmapped' END AS reason FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_ledger(t: Tables) -> DataFrame:
    known = t.nation.filter("n_nationkey % 5 <> 0").select("n_nationkey", F.col("n_name").alias("basin"))
    return t.supplier.join(F.broadcast(known), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "basin", F.when(F.col("basin").isNull(), "unmapped").alias("reason"))


@query("q80_suffix_set", "SELECT user_id, array_to_string(list_sort(list(DISTINCT right(event_type, 1))), '') AS suffixes, count(DISTINCT right(event_type, 1)) >= 3 AS complete FROM events GROUP BY 1")
def suffix_set(t: Tables) -> DataFrame:
    s = F.array_sort(F.collect_set(F.right("event_type", F.lit(1))))
    return t.events.groupBy("user_id").agg(F.array_join(s, "").alias("suffixes"), (F.size(s) >= 3).alias("complete"))


@query("q82_observed_fraction", "SELECT user_id, CASE WHEN max(hour(ts)) > 0 THEN round(least(1.0, count(*) FILTER (event_type = 'view') / max(hour(ts))), 8) END AS fraction FROM events GROUP BY 1")
def observed_fraction(t: Tables) -> DataFrame:
    have, want = F.count(F.when(F.col("event_type") == "view", 1)), F.max(F.hour("ts"))
    return t.events.groupBy("user_id").agg(F.when(want > 0, F.round(F.least(F.lit(1.0), have / want), 8)).alias("fraction"))


@query("q88_domain_check", "SELECT count(*) FILTER (l_discount < 0 OR l_discount > 0.1) AS discount, count(*) FILTER (l_tax < 0 OR l_tax > 0.08) AS tax, count(*) FILTER (l_quantity <> round(l_quantity)) AS fractional FROM lineitem")
def domain_check(t: Tables) -> DataFrame:
    bad = lambda c, name: F.count(F.when(c, 1)).alias(name)
    d, x, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return t.lineitem.agg(bad((d < 0) | (d > 0.1), "discount"), bad((x < 0) | (x > 0.08), "tax"), bad(q != F.round(q), "fractional"))


@query("q93_delay_floor", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'F' THEN 3600 WHEN o_orderstatus = 'O' THEN 7200 ELSE 86400 END AS floor_seconds FROM orders")
def delay_floor(t: Tables) -> DataFrame:
    by_centre = F.create_map(F.lit("F"), F.lit(3600), F.lit("O"), F.lit(7200))
    fixed = F.when(F.startswith("o_orderpriority", F.lit("1")), 0)
    return t.orders.select("o_orderkey", F.coalesce(fixed, F.try_element_at(by_centre, "o_orderstatus"), F.lit(86400)).alias("floor_seconds"))


@query("q94_ordered_chain", "SELECT l_orderkey, l_linenumber, l_discount <= l_tax AND l_tax <= l_quantity AND l_quantity <= l_extendedprice AS ordered FROM lineitem")
def ordered_chain(t: Tables) -> DataFrame:
    d, x, q, p = (F.col(c) for c in ("l_discount", "l_tax", "l_quantity", "l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", ((d <= x) & (x <= q) & (q <= p)).alias("ordered"))


@query("q96_name_denylist", "SELECT p_partkey, regexp_matches(lower(p_name), '(outcome|label|future|post_)') OR p_size % 17 = 0 AS leaks FROM part")
def denylist(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.lower("p_name").rlike("(outcome|label|future|post_)") | (F.col("p_size") % 17 == 0)).alias("leaks"))


@query("q104_verified_binding_all", "SELECT o_orderkey, c_name, md5(c_name) = md5('Customer#' || o_custkey::VARCHAR) AS matches FROM orders JOIN customer ON o_custkey = c_custkey")
def binding_all(t: Tables) -> DataFrame:
    return bound(t.orders, t.customer)


def bound(orders: DataFrame, customer: DataFrame) -> DataFrame:
    j = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    want = F.md5(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).cast("binary"))
    return j.select("o_orderkey", "c_name", (F.md5(F.col("c_name").cast("binary")) == want).alias("matches"))


@query("q108_common_axis", "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT day, round(v, 6) AS v, q FROM a JOIN b USING (day) WHERE q >= 500")
def common_axis(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"))
    b = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    return a.join(b.filter("q >= 500"), "day").select("day", F.round("v", 6).alias("v"), "q")


@query("q111_labelled_windows", "WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS ws, bool_or(event_type = 'purchase') AS hit, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, ws, CASE WHEN hit THEN 'EVENT' WHEN n >= 2 THEN 'CONTROL' ELSE 'UNUSED' END AS label FROM w")
def labelled_windows(t: Tables) -> DataFrame:
    ws = F.window(F.col("ts").cast("timestamp"), "6 hours").getField("start").cast("timestamp_ntz").alias("ws")
    w = t.events.groupBy("user_id", ws).agg(F.bool_or(F.col("event_type") == "purchase").alias("hit"), F.count(F.lit(1)).alias("n"))
    return w.select("user_id", "ws", F.when(F.col("hit"), "EVENT").when(F.col("n") >= 2, "CONTROL").otherwise("UNUSED").alias("label"))


@query("q118_pairs_in_group", "SELECT n_regionkey AS grp, count(*) AS pairs, sum((s_acctbal > c_acctbal)::INT)::BIGINT AS wins FROM supplier JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN customer ON c_nationkey = n1.n_nationkey GROUP BY 1")
def pairs_in_group(t: Tables) -> DataFrame:
    """Pairs are counted by ranking, not formed: of each nation's rows, how many customers lie below each supplier."""
    s = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit(1).alias("s"))
    c = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("s"))
    by_value = s.unionByName(c).groupBy("k", "v").agg(F.sum("s").alias("s"), F.sum(1 - F.col("s")).alias("c"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = by_value.withColumn("w", F.col("s") * below).groupBy("k").agg((F.sum("s") * F.sum("c")).alias("pairs"), F.sum("w").alias("wins"))
    return n.join(t.nation, F.col("k") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("grp")).agg(F.sum("pairs").alias("pairs"), F.sum("wins").alias("wins")).filter("pairs > 0")


@query("q125_epoch_paths", "WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), g AS (SELECT o_custkey, y, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS g FROM y) SELECT o_custkey, CAST(min(y) AS INT) AS first_epoch, count(*) AS length FROM g GROUP BY o_custkey, g")
def epoch_paths(t: Tables) -> DataFrame:
    y = t.orders.select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    g = y.withColumn("g", F.col("y") - F.row_number().over(Window.partitionBy("o_custkey").orderBy("y")))
    return g.groupBy("o_custkey", "g").agg(F.min("y").alias("first_epoch"), F.count(F.lit(1)).alias("length")).drop("g")


@query("q126_key_fallback", "SELECT CASE WHEN c_custkey % 4 = 0 THEN '__distinct__' || c_custkey::VARCHAR ELSE c_mktsegment END AS k, count(*) AS n FROM customer GROUP BY 1")
def key_fallback(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return t.customer.groupBy(F.coalesce(name, F.concat(F.lit("__distinct__"), F.col("c_custkey").cast("string"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("q127_first_owner", "SELECT n_name AS basin, CAST(n_regionkey AS INT) AS owner FROM nation QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY n_regionkey) = 1")
def first_owner(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_name").alias("basin")).agg(F.min("n_regionkey").cast("int").alias("owner"))
