"""Queries on records: scalar derivations, classification, validation, text rules, digests, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as X
from panelforge.plans.registry import Tables, query


@query("q39_wind", "SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_quantity - 25, 2) + pow(l_discount * 100 - 5, 2)), 8) AS speed, round(atan2(l_discount * 100 - 5, l_quantity - 25), 8) AS direction FROM lineitem")
def wind(t: Tables) -> DataFrame:
    u, v = F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(X.wind_speed(u, v), 8).alias("speed"), F.round(X.wind_direction(u, v), 8).alias("direction"))


@query("q40_relative_humidity", "WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS t, p_size - (p_partkey % 20) AS d FROM part) SELECT p_partkey, round(least(100.0, greatest(0.0, 100 * exp(17.625 * d / (243.04 + d) - 17.625 * t / (243.04 + t)))), 6) AS rh, round(2500 + t / 0.0065, 4) AS freezing, greatest(t - 20, 0.0) AS above FROM x")
def humidity(t: Tables) -> DataFrame:
    c = F.col("p_size").cast("double")
    return t.part.select("p_partkey", F.round(X.relative_humidity(c, c - F.col("p_partkey") % 20), 6).alias("rh"), F.round(X.freezing_height(F.lit(2500.0), c), 4).alias("freezing"), X.positive_part(c - 20).alias("above"))


@query("q43_month_filter", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE month(o_orderdate) IN (6, 7, 8) AND year(o_orderdate) BETWEEN 1996 AND 1999")
def month_filter(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.filter((d >= "1996-01-01") & (d < "2000-01-01") & F.month(d).isin(6, 7, 8)).select("o_orderkey", F.to_date(d).alias("day"))


@query("q45_window_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-15'")
def window_slice(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderdate") >= "1997-03-01") & (F.col("o_orderdate") < "1997-03-16")).select("o_orderkey", "o_totalprice")


@query("q47_completeness", "SELECT count(*) AS n, count(*) - count(o_totalprice) AS null_price, count(*) - count(o_orderdate) AS null_date, count(*) FILTER (o_totalprice IS NULL OR o_orderdate IS NULL) AS dropped FROM orders")
def completeness(t: Tables) -> DataFrame:
    gone = lambda c, name: F.count(F.when(F.col(c).isNull(), 1)).alias(name)
    return t.orders.agg(F.count(F.lit(1)).alias("n"), gone("o_totalprice", "null_price"), gone("o_orderdate", "null_date"), F.count(F.when(F.col("o_totalprice").isNull() | F.col("o_orderdate").isNull(), 1)).alias("dropped"))


@query("q52_strict_utc", r"""WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events)
    SELECT event_id, CASE WHEN regexp_matches(raw, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$') THEN CAST(epoch(CAST(replace(left(raw, 19), 'T', ' ') AS TIMESTAMP)) AS BIGINT) END AS seconds FROM x""")
def strict(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", F.unix_timestamp(X.strict_utc(raw)).alias("seconds"))


@query("q54_precision_class", "SELECT event_id, CASE WHEN w IS NULL OR w < 0 THEN 'unresolved' WHEN w <= 3600 THEN 'exact_hour' WHEN w <= 86400 THEN 'day' WHEN w <= 604800 THEN 'week' WHEN w <= 2678400 THEN 'month' ELSE 'coarse' END AS class FROM (SELECT event_id, (event_id * 7907) % 4000000 - 10 AS w FROM events)")
def precision(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.precision_class(((F.col("event_id") * 7907) % 4000000 - 10).cast("double")).alias("class"))


@query("q57_season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, month(o_orderdate) >= 11 OR month(o_orderdate) <= 4 AS winter, (year(o_orderdate) // 5 * 5)::VARCHAR || '-' || (year(o_orderdate) // 5 * 5 + 4)::VARCHAR AS block FROM orders")
def seasons(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", X.season(d).alias("season"), X.is_winter(d).alias("winter"), X.year_block(F.year(d)).alias("block"))


@query("q60_bound_dates", r"""WITH x AS (SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'spring 1999' END AS raw FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(d AS DATE) WHEN 1 THEN CASE WHEN day(d) > 12 THEN CAST(d AS DATE) END END AS bound FROM x""")
def bounds(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("spring 1999")
    return t.orders.select("o_orderkey", X.bound_date(raw).alias("bound"))


@query("q62_classification", "SELECT p_partkey, CASE upper(trim(p_type)) WHEN 'PROMO' THEN 'offer' WHEN 'ECONOMY' THEN 'cheap' WHEN 'STANDARD' THEN 'plain' ELSE 'UNRESOLVED' END AS class FROM part")
def classification(t: Tables) -> DataFrame:
    k = F.upper(F.trim("p_type"))
    return t.part.select("p_partkey", F.when(k == "PROMO", "offer").when(k == "ECONOMY", "cheap").when(k == "STANDARD", "plain").otherwise("UNRESOLVED").alias("class"))


@query("q64_slug", "SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS slug, CASE WHEN lower(trim(p_name)) IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'unknown', 'no information', 'no_information', 'not available', 'unnamed', 'unnamed glacier', 'unidentified', 'not identified', 'no name') THEN '' ELSE trim(p_name) END AS name FROM part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.meaningful(F.col("p_name")).alias("name"))


@query("q65_stable_id", "SELECT o_orderkey, 'ev_' || substr(sha256(o_custkey::VARCHAR || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || coalesce(o_orderstatus, '')), 1, 12) AS id FROM orders")
def stable_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.stable_id("ev_", F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus")).alias("id"))


@query("q66_volume_bounds", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS lo, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice / 1000 END AS hi, l_tax AS total FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(coalesce(lo, hi, total), coalesce(hi, lo, total)) * 1000, 4) AS low, round(greatest(coalesce(lo, hi, total), coalesce(hi, lo, total)) * 1000, 4) AS high FROM x")
def volumes(t: Tables) -> DataFrame:
    low, high = X.volume_bounds(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice") / 1000), F.col("l_tax"), 1000.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("q79_great_circle", "WITH x AS (SELECT c_custkey, (c_custkey % 180) - 90.0 AS a, (c_custkey * 7 % 360) - 180.0 AS b FROM customer) SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(28.0 - a) / 2), 2) + cos(radians(a)) * cos(radians(28.0)) * pow(sin(radians(84.0 - b) / 2), 2)))), 5) AS km FROM x")
def distance(t: Tables) -> DataFrame:
    a, b = (F.col("c_custkey") % 180) - 90.0, (F.col("c_custkey") * 7 % 360) - 180.0
    return t.customer.select("c_custkey", F.round(X.great_circle_km(a, b, F.lit(28.0), F.lit(84.0)), 5).alias("km"))


@query("q91_severity", "SELECT event_id, round(0.7 * least(1.0, abs(value) / 5) + 0.3 * least(1.0, (event_id % 4) / 3.0), 8) AS severity FROM events")
def severity(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(0.7 * F.least(F.lit(1.0), F.abs("value") / 5) + 0.3 * F.least(F.lit(1.0), (F.col("event_id") % 4) / 3.0), 8).alias("severity"))


@query("q92_rule_violations", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice <= 100000 THEN 'small' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_custkey % 10 = 0 THEN 'sampled' END], lambda x: x IS NOT NULL), '|') AS problems FROM orders")
def violations(t: Tables) -> DataFrame:
    p = X.problems((F.col("o_totalprice") <= 100000, "small"), (F.col("o_orderstatus") == "O", "open"), (F.col("o_custkey") % 10 == 0, "sampled"))
    return t.orders.select("o_orderkey", F.array_join(p, "|").alias("problems"))


@query("q95_embargo", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_discount IS NOT NULL THEN greatest(l_quantity, l_tax * 300, l_discount * 400) END AS embargo FROM lineitem")
def embargo(t: Tables) -> DataFrame:
    parts = [F.col("l_quantity"), F.col("l_tax") * 300, F.col("l_discount") * 400]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity").isNotNull() & F.col("l_tax").isNotNull() & F.col("l_discount").isNotNull(), F.greatest(*parts)).alias("embargo"))


@query("q98_text_claims", r"SELECT doc_id, len(regexp_extract_all(lower(text), '(licensed|released|rights reserved)'))::BIGINT AS findings FROM documents WHERE regexp_matches(lower(text), '(licensed|released|rights reserved)')")
def claims(t: Tables) -> DataFrame:
    n = F.regexp_count(F.lower("text"), F.lit("(licensed|released|rights reserved)")).cast("long")
    return t.documents.select("doc_id", n.alias("findings")).filter("findings > 0")


@query("q99_leakage_audit", "WITH s AS (SELECT *, CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM lineitem) SELECT l_suppkey, count(DISTINCT split) > 1 AS crosses, count(*) FILTER (l_discount > 0.09) AS flagged, count(*) AS n FROM s GROUP BY 1")
def leakage(t: Tables) -> DataFrame:
    split = F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test")
    return t.lineitem.groupBy("l_suppkey").agg((F.count_distinct(split) > 1).alias("crosses"), F.count(F.when(F.col("l_discount") > 0.09, 1)).alias("flagged"), F.count(F.lit(1)).alias("n"))


@query("q12_json_flatten", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
def flatten(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("q7_equal_day_sets", "WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, array_to_string(list_sort(list(DISTINCT day(o_orderdate))), ',') AS days FROM orders GROUP BY 1, 2) SELECT days, count(*) AS months, CAST(min(y * 100 + m) AS INT) AS first_month FROM m GROUP BY 1")
def day_sets(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.array_join(F.array_sort(F.collect_set(F.dayofmonth("o_orderdate"))), ",").alias("days"))
    return m.groupBy("days").agg(F.count(F.lit(1)).alias("months"), F.min(F.col("y") * 100 + F.col("m")).alias("first_month"))


@query("q5_completeness_gate", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT date_trunc('hour', ts)) AS hours, count(DISTINCT date_trunc('hour', ts)) = max(day(last_day(ts))) * 24 AS complete FROM events GROUP BY 1")
def gate(t: Tables) -> DataFrame:
    n = F.count_distinct(F.date_trunc("hour", "ts"))
    return t.events.groupBy(F.trunc("ts", "month").alias("month")).agg(n.alias("hours"), (n == F.max(F.dayofmonth(F.last_day("ts"))) * 24).alias("complete"))


@query("q163_census", "SELECT source, lang, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, count(*) - count(text) AS missing FROM documents GROUP BY 1, 2")
def census(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count(F.when(F.col("text").isNull(), 1)).alias("missing"))


@query("q164_multi_label_counts", "SELECT label, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished FROM (SELECT o_orderstatus, unnest([o_orderpriority, 'status-' || o_orderstatus]) AS label FROM orders) GROUP BY 1")
def multi_label(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderstatus", F.explode(F.array("o_orderpriority", F.concat(F.lit("status-"), "o_orderstatus"))).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"))


@query("q165_depth_distribution", "WITH d AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS depth FROM orders GROUP BY 1) SELECT depth, count(*) AS n FROM d GROUP BY 1")
def depth(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("depth")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("q174_key_digest", "SELECT n_regionkey AS region, sha256(string_agg(n_nationkey::VARCHAR || ':' || n_name, '|' ORDER BY n_nationkey::VARCHAR || ':' || n_name)) AS digest FROM nation GROUP BY 1")
def key_digest(t: Tables) -> DataFrame:
    keys = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), "n_name"))), "|")
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.sha2(keys.cast("binary"), 256).alias("digest"))


@query("q177_mean_drift", "WITH m AS (SELECT year(o_orderdate) AS era, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT CAST(a.era AS INT) AS era_a, CAST(b.era AS INT) AS era_b, round(abs(a.m - b.m), 4) AS shift FROM m a JOIN m b ON a.era < b.era")
def drift(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.year("o_orderdate").alias("era_a")).agg(F.avg("o_totalprice").alias("ma"))
    n = m.select(F.col("era_a").alias("era_b"), F.col("ma").alias("mb"))
    return m.join(F.broadcast(n), F.col("era_a") < F.col("era_b")).select("era_a", "era_b", F.round(F.abs(F.col("ma") - F.col("mb")), 4).alias("shift"))


@query("q180_ledger_integrity", "SELECT md5(c_name) AS digest, count(DISTINCT c_custkey) AS ids FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1 UNION ALL SELECT 'checked', count(*) FROM customer")
def ledger(t: Tables) -> DataFrame:
    bad = t.customer.groupBy(F.md5(F.col("c_name").cast("binary")).alias("digest")).agg(F.count_distinct("c_custkey").alias("ids")).filter("ids > 1")
    return bad.unionByName(t.customer.agg(F.lit("checked").alias("digest"), F.count(F.lit(1)).alias("ids")))


@query("q208_duplicate_ordinal", "SELECT o_orderkey, CASE WHEN n = 1 THEN k ELSE k || '#' || n::VARCHAR END AS id FROM (SELECT o_orderkey, 'c' || o_custkey::VARCHAR AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def duplicate_ordinal(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", k.alias("k"), n.alias("n")).select("o_orderkey", F.when(F.col("n") == 1, F.col("k")).otherwise(F.concat("k", F.lit("#"), F.col("n").cast("string"))).alias("id"))


@query("q262_gate_status", "WITH g AS (SELECT o_custkey, bool_and(o_totalprice > 1000) AS a, bool_or(o_orderstatus = 'F') AS b, count(*) >= 5 AS c FROM orders GROUP BY 1) SELECT CASE WHEN a AND b AND c THEN 'PASS' WHEN a OR b THEN 'PARTIAL' ELSE 'FAIL' END AS status, count(*) AS n FROM g GROUP BY 1")
def gate_status(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"), (F.count(F.lit(1)) >= 5).alias("c"))
    status = F.when(F.col("a") & F.col("b") & F.col("c"), "PASS").when(F.col("a") | F.col("b"), "PARTIAL").otherwise("FAIL")
    return g.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q323_holdout_geography", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN nullif(trim(n_name), '') END, CASE WHEN s_suppkey % 4 = 1 THEN r_name END, 'grid-' || (s_suppkey % 90 // 2)::VARCHAR) AS holdout FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def geography(t: Tables) -> DataFrame:
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 4 == 0, F.nullif(F.trim("n_name"), F.lit(""))), F.when(F.col("s_suppkey") % 4 == 1, F.col("r_name")), F.concat(F.lit("grid-"), F.expr("(s_suppkey % 90) div 2").cast("string"))).alias("holdout"))
