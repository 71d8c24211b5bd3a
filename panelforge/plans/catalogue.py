"""Queries on catalogue records, review documents and case rules (inventory 2.2, 2.9b, 2.9c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import catalogue as C
from panelforge.functions import scalars as X
from panelforge.operators import tables as R
from panelforge.plans.registry import Tables, query

LINES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 45 THEN l_quantity END AS a, NULL::DOUBLE AS b FROM lineitem"


def gappy(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("a"), F.lit(None).cast("double").alias("b"))


@query("q48_listwise_rows", f"SELECT l_orderkey, l_linenumber, a FROM ({LINES}) WHERE a IS NOT NULL")
def listwise(t: Tables) -> DataFrame:
    return R.without_empty_columns(gappy(t)).na.drop()


@query("q408_columns_with_values", f"SELECT l_orderkey, l_linenumber, a FROM ({LINES})")
def with_values(t: Tables) -> DataFrame:
    return R.without_empty_columns(gappy(t))


@query("q69_citations", "SELECT p_partkey, len(r)::INT AS n, array_to_string(list_transform(r, lambda x: x || '@en'), ';') AS cited FROM (SELECT p_partkey, list_filter(list_transform(string_split(p_name || '; ' || p_brand, ';'), lambda x: trim(x)), lambda x: x <> '') AS r FROM part)")
def citations(t: Tables) -> DataFrame:
    refs = F.transform(X.split_list(F.concat("p_name", F.lit("; "), "p_brand")), lambda x: F.struct(x.alias("reference"), F.lit("en").alias("language")))
    p = t.part.select("p_partkey", refs.alias("r"))
    return p.select("p_partkey", F.size("r").alias("n"), F.array_join(F.transform("r", lambda x: F.concat(x["reference"], F.lit("@"), x["language"])), ";").alias("cited"))


@query("q70_impact_locations", """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN [{'lat': s_acctbal / 100, 'lon': s_acctbal / 40}, {'lat': 10.0, 'lon': 20.0}] WHEN 1 THEN [] END AS points, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 90 END AS lat, s_acctbal / 30 AS lon FROM supplier),
    c AS (SELECT s_suppkey, list_filter(CASE WHEN len(points) > 0 THEN points WHEN lat IS NOT NULL AND lon IS NOT NULL THEN [{'lat': lat, 'lon': lon}] ELSE [] END, lambda p: p.lat BETWEEN -90 AND 90 AND p.lon BETWEEN -180 AND 180) AS found FROM s)
    SELECT s_suppkey, len(found)::INT AS n, round(found[1].lat, 6) AS lat FROM c""")
def impact(t: Tables) -> DataFrame:
    k, point = F.col("s_suppkey") % 3, lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon"))
    points = F.when(k == 0, F.array(point(F.col("s_acctbal") / 100, F.col("s_acctbal") / 40), point(F.lit(10), F.lit(20)))).when(k == 1, F.array().cast("array<struct<lat: double, lon: double>>"))
    found = C.impact_locations(points, F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") / 90), F.col("s_acctbal") / 30)
    return t.supplier.select("s_suppkey", found.alias("found")).select("s_suppkey", F.size("found").alias("n"), F.round(F.try_element_at("found", F.lit(1))["lat"], 6).alias("lat"))


@query("q71_normalised_records", """SELECT o_orderkey, 'ev_' || substr(sha256(o_custkey::VARCHAR || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 12) AS event_id, o_orderdate::DATE AS date_min, (o_orderdate + INTERVAL 7 DAY)::DATE AS date_max,
    CASE o_orderstatus WHEN 'O' THEN '' ELSE o_orderstatus END AS status, o_totalprice / 2 AS volume_min, round(o_totalprice, 2) AS volume_max, o_totalprice >= 100000 AS detectable,
    CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS mechanism, CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END AS n_problems FROM orders""")
def normalised(t: Tables) -> DataFrame:
    """A catalogue row from raw cells: identity, date bounds, text without placeholders, volume bounds, season, problems."""
    day = F.to_date("o_orderdate")
    low, high = X.volume_bounds(F.col("o_totalprice") * 0.5, F.col("o_totalprice"), F.col("o_totalprice"), 1.0)
    status = X.meaningful(F.when(F.col("o_orderstatus") == "O", " No Information ").otherwise(F.col("o_orderstatus")))
    return t.orders.select(
        "o_orderkey",
        X.stable_id("ev_", F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_id"),
        day.alias("date_min"),
        F.date_add(day, 7).alias("date_max"),
        status.alias("status"),
        low.alias("volume_min"),
        F.round(high, 2).alias("volume_max"),
        (high >= 100000).alias("detectable"),
        X.season(day).alias("season"),
        X.slug(F.col("o_orderpriority")).alias("mechanism"),
        F.size(X.problems((F.col("o_totalprice").isNull(), "no volume"))).alias("n_problems"),
    )


RAW_DATES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '19x8' ELSE strftime(o_orderdate, '%Y') END AS ye, CASE o_orderkey % 10 WHEN 0 THEN '' ELSE '1990' END AS ya, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE month(o_orderdate)::VARCHAR END AS mo, CASE o_orderkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '31' ELSE day(o_orderdate)::VARCHAR END AS da FROM orders"


@query("q75_timing_interval", f"""WITH r AS ({RAW_DATES}), y AS (SELECT o_orderkey, nullif(nullif(ye, 'NA'), '') AS e, coalesce(nullif(nullif(ye, 'NA'), ''), nullif(ya, '')) AS w, nullif(mo, '') AS m, nullif(nullif(da, 'NA'), '') AS d FROM r),
    s AS (SELECT *, TRY_CAST(w AS INT) AS yy FROM y),
    b AS (SELECT *, CASE WHEN m IS NOT NULL AND d IS NOT NULL THEN TRY_CAST(yy::VARCHAR || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) WHEN m IS NOT NULL THEN TRY_CAST(yy::VARCHAR || '-' || lpad(m, 2, '0') || '-01' AS DATE) ELSE TRY_CAST(yy::VARCHAR || '-01-01' AS DATE) END AS a FROM s),
    i AS (SELECT *, (CASE WHEN m IS NOT NULL AND d IS NOT NULL THEN a + INTERVAL 1 DAY WHEN m IS NOT NULL THEN a + INTERVAL 1 MONTH ELSE a + INTERVAL 1 YEAR END)::DATE AS z FROM b)
    SELECT o_orderkey, a AS "start", z AS "end", CASE WHEN a IS NULL THEN NULL WHEN m IS NOT NULL AND d IS NOT NULL THEN 'day' WHEN m IS NOT NULL THEN CASE WHEN z - a <= 30 THEN 'interval' ELSE 'month' END ELSE 'year' END AS "precision",
           CASE WHEN w IS NULL THEN 'unresolved_timing' WHEN yy IS NULL THEN 'unparseable_year' WHEN a IS NULL THEN 'unparseable_date' END AS reason FROM i""")
def timing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = t.orders.select(
        "o_orderkey",
        F.when(k % 5 == 0, "NA").when(k % 5 == 1, "19x8").otherwise(F.year("o_orderdate").cast("string")).alias("ye"),
        F.when(k % 10 == 0, "").otherwise("1990").alias("ya"),
        F.when(k % 3 == 0, "").otherwise(F.month("o_orderdate").cast("string")).alias("mo"),
        F.when(k % 4 == 0, "NA").when(k % 4 == 1, "31").otherwise(F.dayofmonth("o_orderdate").cast("string")).alias("da"),
    )
    return raw.select("o_orderkey", *[c.alias(n) for n, c in C.timing_interval(*map(F.col, ("ye", "ya", "mo", "da"))).items()])


@query("q81_observability_gate", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 AND s_nationkey < 20 AND s_suppkey % 4 <> 0 THEN 'OBSERVABLE' ELSE 'UNOBSERVABLE' END AS verdict, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'no_response' END, CASE WHEN s_nationkey >= 20 THEN 'too_far' END, CASE WHEN s_suppkey % 4 = 0 THEN 'channels' END], lambda x: x IS NOT NULL), ',') AS reasons FROM supplier")
def observability(t: Tables) -> DataFrame:
    reasons = X.problems((F.col("s_acctbal") < 0, "no_response"), (F.col("s_nationkey") >= 20, "too_far"), (F.col("s_suppkey") % 4 == 0, "channels"))
    return t.supplier.select("s_suppkey", F.when(F.size(reasons) == 0, "OBSERVABLE").otherwise("UNOBSERVABLE").alias("verdict"), F.array_join(reasons, ",").alias("reasons"))


def derived_gate(rows: DataFrame) -> DataFrame:
    """(s_suppkey, problems) of shipments by supplier: line channels, shares of both orientations, response in value, months covered."""
    g = rows.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_distinct("l_linenumber").alias("channels"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("turned"),
        F.sum("l_extendedprice").alias("response"), F.count_distinct(F.date_trunc("month", "l_shipdate")).alias("months"))
    told = X.problems((F.col("channels") < 6, "channels"), (~F.col("turned").between(0.2, 0.8), "orientation"), (F.col("response") < 1000000, "response"), (F.col("months") < 24, "coverage"))
    return g.select("s_suppkey", told.alias("problems"))


_GATE = """SELECT l_suppkey AS s_suppkey, list_filter([CASE WHEN count(DISTINCT l_linenumber) < 6 THEN 'channels' END, CASE WHEN avg((l_returnflag = 'R')::INT) NOT BETWEEN 0.2 AND 0.8 THEN 'orientation' END,
    CASE WHEN sum(l_extendedprice) < 1000000 THEN 'response' END, CASE WHEN count(DISTINCT date_trunc('month', l_shipdate)) < 24 THEN 'coverage' END], lambda x: x IS NOT NULL) AS p FROM lineitem"""


@query("q418_carried_gate", f"WITH a AS ({_GATE} WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1), b AS ({_GATE} GROUP BY 1) SELECT s_suppkey, CASE WHEN a.p IS NULL THEN 'none' WHEN len(a.p) = 0 THEN 'OBSERVABLE' ELSE 'UNOBSERVABLE' END AS carried, CASE WHEN len(b.p) = 0 THEN 'OBSERVABLE' ELSE 'UNOBSERVABLE' END AS verdict, array_to_string(b.p, ',') AS problems, a.p IS NULL OR (len(a.p) = 0) <> (len(b.p) = 0) AS differs FROM b LEFT JOIN a USING (s_suppkey)")
def carried(t: Tables) -> DataFrame:
    """A gate's verdict carried along from earlier shipments, against channels, orientation, response and coverage derived anew from all."""
    verdict = lambda c: F.when(F.size(c) == 0, "OBSERVABLE").otherwise("UNOBSERVABLE")
    before = derived_gate(t.lineitem.filter(F.col("l_shipdate") < "1998-06-01")).withColumnRenamed("problems", "old")
    both = derived_gate(t.lineitem).join(before, "s_suppkey", "left")
    told = F.when(F.col("old").isNull(), "none").otherwise(verdict("old"))
    return both.select("s_suppkey", told.alias("carried"), verdict("problems").alias("verdict"), F.array_join("problems", ",").alias("problems"), (told != verdict("problems")).alias("differs"))


@query("q100_row_digest", "SELECT n_nationkey, sha256('n_name=' || coalesce(n_name, '') || '|n_nationkey=' || n_nationkey::VARCHAR || '|n_regionkey=' || n_regionkey::VARCHAR) AS digest FROM nation")
def row_digest(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", R.row_digest("n_nationkey", "n_name", "n_regionkey").alias("digest"))


@query("q173_column_digests", "SELECT 'c_custkey' AS name, count(c_custkey) AS n, sum(('0x' || substr(sha256(c_custkey::VARCHAR), 1, 12))::BIGINT)::BIGINT AS digest FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), sum(('0x' || substr(sha256(c_mktsegment), 1, 12))::BIGINT)::BIGINT FROM customer")
def column_digests(t: Tables) -> DataFrame:
    return R.column_digests(t.customer, ["c_custkey", "c_mktsegment"])


@query("q175_feature_digests", "SELECT 'v' AS name, count(v) AS n, sum(('0x' || substr(sha256(v), 1, 12))::BIGINT)::BIGINT AS digest FROM (SELECT printf('%.6f', round(value, 6)) AS v FROM events)")
def feature_digests(t: Tables) -> DataFrame:
    """Digests of rounded values: the same however the rows lie."""
    return R.column_digests(t.events.select(F.format_string("%.6f", F.round("value", 6)).alias("v")), ["v"])


def customer_key() -> Column:
    return F.concat_ws("|", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))


@query("q413_key_digest", "SELECT count(*) AS n, sum(('0x' || substr(sha256(c_nationkey::VARCHAR || '|' || c_custkey::VARCHAR), 1, 12))::BIGINT)::BIGINT AS digest FROM customer")
def key_digest(t: Tables) -> DataFrame:
    return R.column_digests(t.customer.select(customer_key().alias("k")), ["k"]).select("n", "digest")


@query("q412_row_key", "SELECT c_custkey, c_nationkey::VARCHAR || '|' || c_custkey::VARCHAR AS row_key FROM customer")
def row_key(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", customer_key().alias("row_key"))


@query("q414_distinct_pairs", "SELECT DISTINCT trim(c_mktsegment) AS unit, c_nationkey::VARCHAR AS basin FROM customer")
def pairs(t: Tables) -> DataFrame:
    return t.customer.select(F.trim("c_mktsegment").alias("unit"), F.col("c_nationkey").cast("string").alias("basin")).distinct()


@query("q124_edge_channels", """WITH e AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS one, l_discount * 10 AS iou, l_quantity / 50 AS f, l_tax * 12 AS g FROM lineitem)
    SELECT l_orderkey, l_linenumber, one AND iou >= 0.5 AND f >= 0.5 AS strict, coalesce(one AND greatest(f, g) >= 0.8 AND greatest(f / g, g / f) <= 2 AND f > 0 AND g > 0, FALSE) AS containment, CASE WHEN f > 0 AND g > 0 THEN round(greatest(f / g, g / f), 6) END AS ratio FROM e""")
def channels(t: Tables) -> DataFrame:
    c = C.edge_channels(F.col("l_linestatus") == "O", F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 12, 0.5, 0.5, 0.8, 2.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", c["strict"].alias("strict"), c["containment"].alias("containment"), F.round(c["ratio"], 6).alias("ratio"))


@query("q371_implied_area", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(l_quantity / l_tax, 6) END AS area FROM lineitem")
def implied(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.implied_area(F.col("l_quantity"), F.col("l_tax")), 6).alias("area"))


@query("q369_degree_over_one", "SELECT l_partkey AS node, 'in' AS side, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT l_orderkey, 'out', count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) > 1")
def degrees(t: Tables) -> DataFrame:
    return R.degrees_over(t.lineitem.filter("l_returnflag = 'R'"), "l_orderkey", "l_partkey", 1)


@query("q182_support_fraction", "SELECT p_partkey, CASE WHEN p_size - 5 > 0 AND p_partkey % 9 <= p_size - 5 THEN round((p_partkey % 9) / (p_size - 5.0), 8) END AS fraction FROM part")
def support(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(C.support_fraction(F.col("p_size") - 5, F.col("p_partkey") % 9), 8).alias("fraction"))


@query("q301_event_observability", """WITH e AS (SELECT o_orderkey, o_totalprice AS v, CASE o_orderstatus WHEN 'O' THEN 'FULL' WHEN 'F' THEN 'AVAILABLE' ELSE 'PARTIAL' END AS c, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN v < 50000 THEN 'BELOW_MIN_DETECTABLE_SIZE' END, CASE WHEN c NOT IN ('FULL', 'AVAILABLE') THEN 'OBSERVATION_NOT_ADEQUATE:' || c END, CASE WHEN DATE '1998-01-01' > d THEN 'FEATURE_NOT_AVAILABLE_AS_OF_EVENT:snow' END, 'FEATURE_AVAILABILITY_UNKNOWN:wind'], lambda x: x IS NOT NULL)), ',') AS reasons FROM e""")
def event_observability(t: Tables) -> DataFrame:
    cover = F.when(F.col("o_orderstatus") == "O", "FULL").when(F.col("o_orderstatus") == "F", "AVAILABLE").otherwise("PARTIAL")
    since = F.create_map(F.lit("snow"), F.lit("1998-01-01").cast("date"))
    return t.orders.select("o_orderkey", F.array_join(C.observability_reasons(F.col("o_totalprice"), F.lit(50000.0), cover, since, ["snow", "wind"], F.to_date("o_orderdate")), ",").alias("reasons"))


@query("q337_digest_domain", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MISSING' WHEN c_custkey % 3 = 1 THEN 'MATCHES_RANKED_ARRAY_CANONICAL' ELSE 'HISTORICAL_ORPHAN_UNKNOWN_DOMAIN' END AS status FROM customer")
def domains(t: Tables) -> DataFrame:
    canonical = F.sha2(F.col("c_name").cast("binary"), 256)
    declared = F.when(F.col("c_custkey") % 3 == 1, canonical).when(F.col("c_custkey") % 3 == 2, F.sha2(F.lit("other").cast("binary"), 256))
    return t.customer.select("c_custkey", C.domain_status(declared, canonical).alias("status"))


@query("q358_triple_gate", "SELECT o_custkey, CASE WHEN avg(x) > 0 AND avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)) > 0 AND avg((x <= 0)::INT) < 0.05 THEN 'PASS' ELSE 'NULL' END AS verdict FROM (SELECT o_custkey, o_totalprice - 60000 AS x FROM orders) GROUP BY 1")
def gates(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", (F.col("o_totalprice") - 60000).alias("x"))
    g = o.groupBy("o_custkey").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("n"), F.avg((F.col("x") <= 0).cast("int")).alias("p"))
    return g.select("o_custkey", C.triple_gate(F.col("m"), F.col("m") - 1.96 * F.col("s") / F.sqrt("n"), F.col("p")).alias("verdict"))


@query("q384_case_problems", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'opportunity' END, CASE WHEN o_orderkey % 13 = 0 THEN 'source' END, CASE WHEN o_orderkey % 7 = 0 THEN 'cutoff' WHEN o_orderkey % 5 = 0 THEN 'postdates' END], lambda x: x IS NOT NULL), ',') AS problems FROM orders""")
def lineage(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    cutoff = F.when(k % 7 == 0, day).when(k % 5 == 0, F.concat(day, F.lit("T12:00:00Z"))).otherwise(F.concat(day, F.lit("T00:00:00Z")))
    found = C.case_problems(F.when(k % 11 == 0, " ").otherwise("o"), F.when(k % 13 != 0, "s"), cutoff, F.concat(day, F.lit("T06:00:00+00:00")))
    return t.orders.select("o_orderkey", F.array_join(found, ",").alias("problems"))


PRECISION = "CASE o_orderstatus WHEN 'O' THEN 'interval' WHEN 'F' THEN 'month' ELSE 'day' END"


@query("q386_admissible_horizons", f"SELECT o_orderkey, h::INT AS horizon, CASE WHEN {PRECISION} = 'month' THEN h IN (0, 30) WHEN {PRECISION} = 'interval' THEN o_orderkey % 40 <= h ELSE TRUE END AS admissible FROM orders, (SELECT unnest([0, 3, 7, 30]) AS h)")
def admissible(t: Tables) -> DataFrame:
    precision = F.when(F.col("o_orderstatus") == "O", "interval").when(F.col("o_orderstatus") == "F", "month").otherwise("day")
    h = t.orders.select("o_orderkey", precision.alias("p"), (F.col("o_orderkey") % 40).alias("w"), F.explode(F.array(*map(F.lit, (0, 3, 7, 30)))).alias("horizon"))
    return h.select("o_orderkey", "horizon", C.horizon_admissible(F.col("p"), F.col("w"), F.col("horizon")).alias("admissible"))


@query("q463_lookback_days", "SELECT c_custkey, (c_custkey % 12)::INT AS days FROM customer")
def lookbacks(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", C.lookback_days(F.concat((F.col("c_custkey") % 12).cast("string"), F.lit("d"))).alias("days"))


@query("q468_mechanism", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'UNSPECIFIED' END AS mechanism FROM orders")
def mechanism(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C.first_named(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("mechanism"))


@query("q500_group_fallback", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus WHEN o_orderkey % 2 > 0 THEN o_orderpriority ELSE '' END AS grp FROM orders")
def group_fallback(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderpriority")), F.lit("")).alias("grp"))


@query("q477_midpoint_season", "SELECT l_orderkey, l_linenumber, CASE WHEN month(m) IN (12, 1, 2) THEN 'DJF' WHEN month(m) IN (3, 4, 5) THEN 'MAM' WHEN month(m) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season FROM (SELECT *, l_shipdate + to_seconds(l_linenumber * 43200.0) AS m FROM lineitem)")
def midpoint_season(t: Tables) -> DataFrame:
    end = F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 86400)
    return t.lineitem.select("l_orderkey", "l_linenumber", C.observed_season(F.col("l_shipdate").cast("timestamp"), end).alias("season"))


@query("q485_tokens", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE printf('%.6f', event_id / 4.0) END AS token FROM events")
def tokens(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    return t.events.select("event_id", C.finite_or_token(F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("event_id") / 4)).alias("token"))


@query("q487_reordered", "SELECT vec_id, round(embedding[3]::DOUBLE, 6) AS a, round(embedding[1]::DOUBLE, 6) AS b FROM embeddings")
def reorder(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", C.reordered(F.col("embedding"), F.array(F.lit(2), F.lit(0), F.lit(1))).alias("v")).select("vec_id", F.round(F.col("v")[0].cast("double"), 6).alias("a"), F.round(F.col("v")[1].cast("double"), 6).alias("b"))


@query("q495_cell_pair", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_size / 2 END AS lat, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_size / 4 END AS lon FROM part")
def cell_pairs(t: Tables) -> DataFrame:
    k, a, b = F.col("p_partkey") % 3, (F.col("p_size") * 0.5).cast("string"), (F.col("p_size") * 0.25).cast("string")
    text = F.when(k == 0, F.format_string("[%s, %s]", a, b)).when(k == 1, F.format_string('{"lat": %s, "lon": %s}', a, b)).otherwise("here")
    pair = C.cell_pair(text)
    return t.part.select("p_partkey", F.try_element_at(pair, F.lit(1)).alias("lat"), F.try_element_at(pair, F.lit(2)).alias("lon"))


@query("q498_band_label", "SELECT p_size, replace(CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END, '.', 'p') AS label FROM (SELECT DISTINCT p_size FROM part)")
def band_labels(t: Tables) -> DataFrame:
    hz = F.regexp_replace((F.col("p_size") / 2).cast("decimal(10,4)").cast("string"), r"\.?0+$", "")
    return t.part.select("p_size").distinct().select("p_size", F.replace(hz, F.lit("."), F.lit("p")).alias("label"))


@query("q499_nested_rounding", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 8))), 5) AS total FROM embeddings")
def nested_rounding(t: Tables) -> DataFrame:
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 8))
    return t.embeddings.select("vec_id", F.round(F.aggregate(rounded, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("q434_box_key", "SELECT n_nationkey, '{\"lat\":[' || n_nationkey || ',' || n_nationkey + 1 || '],\"lon\":[' || n_regionkey || ',' || n_regionkey + 1 || ']}' AS box FROM nation")
def box_key(t: Tables) -> DataFrame:
    span = lambda c: F.array(F.col(c), F.col(c) + 1)
    return t.nation.select("n_nationkey", F.to_json(F.struct(span("n_nationkey").alias("lat"), span("n_regionkey").alias("lon"))).alias("box"))


@query("q438_unit_box", "SELECT s_nationkey, min(s_acctbal) AS south, max(s_acctbal) AS north, min(s_suppkey) AS west, max(s_suppkey) AS east, (s_nationkey % 2 = 0) AS even FROM supplier GROUP BY 1")
def unit_box(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.min("s_acctbal").alias("south"), F.max("s_acctbal").alias("north"), F.min("s_suppkey").alias("west"), F.max("s_suppkey").alias("east")).withColumn("even", F.col("s_nationkey") % 2 == 0)


@query("q415_normalised_events", """WITH e AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + to_days((o_orderkey % 40 + 1)::INT) AS z FROM orders)
    SELECT o_orderkey, 'src:v1:' || o_orderkey AS event_id, (epoch(z) - epoch(a))::BIGINT AS uncertainty_seconds, CASE WHEN z - a <= INTERVAL 1 DAY THEN 'day' WHEN z - a <= INTERVAL 7 DAY THEN 'week' WHEN z - a <= INTERVAL 31 DAY THEN 'month' ELSE 'coarse' END AS timing_class,
           CASE WHEN o_orderkey % 6 = 0 THEN 'cascade' ELSE 'solo:src:v1:' || o_orderkey END AS cascade_group_id, strftime(a + (z - a) / 2, '%Y-%m-%dT%H:%M:%SZ') AS middle FROM e""")
def normalised_events(t: Tables) -> DataFrame:
    """Canonical events: a non-empty interval, its class and length, its middle, and a group of its own by default."""
    a = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    e = t.orders.select("o_orderkey", a.alias("a"), (a + (F.col("o_orderkey") % 40 + 1) * 86400).alias("z"))
    e = e.withColumn("n", F.when(F.col("z") > F.col("a"), F.col("z") - F.col("a")).otherwise(F.raise_error(F.lit("event interval must be non-empty")).cast("long")))
    ident = F.concat_ws(":", F.lit("src"), F.lit("v1"), F.col("o_orderkey").cast("string"))
    group = F.coalesce(F.when(F.col("o_orderkey") % 6 == 0, "cascade"), F.concat(F.lit("solo:"), ident))
    middle = F.date_format(F.timestamp_seconds((F.col("a") + F.col("z")) / 2), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("o_orderkey", ident.alias("event_id"), F.col("n").alias("uncertainty_seconds"), X.precision_class(F.col("n")).alias("timing_class"), group.alias("cascade_group_id"), middle.alias("middle"))


@query("q360_verified_index", "SELECT o_orderkey AS id, o_custkey AS place, o_orderdate AS since FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IS NOT NULL")
def verified(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F' AND o_orderkey IS NOT NULL").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("place"), F.col("o_orderdate").alias("since"))


@query("q361_resolved_evidence", """SELECT l_suppkey AS claim, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS first_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderdate <= l_shipdate AND o_orderdate + INTERVAL 90 DAY >= l_shipdate GROUP BY 1""")
def resolved(t: Tables) -> DataFrame:
    """Cited evidence that is verified and whose coverage contains the claim's day."""
    v = verified(t)
    cited = t.lineitem.select(F.col("l_suppkey").alias("claim"), F.col("l_orderkey").alias("id"), "l_shipdate")
    held = cited.join(v, "id").filter("since <= l_shipdate AND since + INTERVAL 90 DAYS >= l_shipdate")
    return held.groupBy("claim").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id"))


@query("q362_independent_events", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey IS NOT NULL")
def independent(t: Tables) -> DataFrame:
    r = t.orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("state"), F.struct(F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("rank")).alias("claim"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("who")).alias("r"))
    return r.filter((F.col("r.state") == "F") & (F.col("r.claim.size") > 50000) & F.col("r.claim.rank").isin("1-URGENT", "2-HIGH") & (F.col("r.at") >= "1996-01-01") & F.col("r.who").isNotNull()).select("o_orderkey")


@query("q363_review_complete", "SELECT c_custkey, c_name <> '' AND c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AS complete FROM customer")
def complete(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ((F.col("c_name") != "") & (F.col("c_acctbal") > 0) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("complete"))


@query("q365_review_rows", "SELECT DISTINCT l_suppkey AS source_id, 'PENDING' AS state, '' AS reviewer, '' AS note FROM lineitem")
def review_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("source_id")).distinct().select("source_id", F.lit("PENDING").alias("state"), F.lit("").alias("reviewer"), F.lit("").alias("note"))


@query("q381_failed_gates", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'balance' END, CASE WHEN NOT c_nationkey < 20 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS failed FROM customer")
def failed(t: Tables) -> DataFrame:
    gates = F.create_map(F.lit("balance"), F.col("c_acctbal") > 0, F.lit("nation"), F.col("c_nationkey") < 20)
    return t.customer.select("c_custkey", F.array_join(F.array_sort(F.map_keys(F.map_filter(gates, lambda k, v: ~v))), ",").alias("failed"))


@query("q391_column_audit", "SELECT 'l_tax' AS name, 'predictor' AS role, count(l_tax) AS n, round(min(l_tax) + 0, 6) AS low, round(max(l_tax), 6) AS high FROM lineitem UNION ALL SELECT 'l_quantity', 'label', count(l_quantity), min(l_quantity), max(l_quantity) FROM lineitem")
def audit(t: Tables) -> DataFrame:
    return R.column_audit(t.lineitem, {"l_tax": "predictor", "l_quantity": "label"})


@query("q396_many_owners", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY 1")
def owners(t: Tables) -> DataFrame:
    """Basins' lists of lakes inverted: a lake named by several basins is a conflict."""
    lists = t.lineitem.groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    return lists.select("l_suppkey", F.explode("parts").alias("l_partkey")).groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).withColumn("conflict", F.col("n") > 1)


@query("q398_reader_quality", "SELECT 'value' AS name, count(*) FILTER (value IS NULL) AS n_null, min(value) AS low, max(value) AS high, count(DISTINCT month(ts)) AS months FROM events")
def quality(t: Tables) -> DataFrame:
    return t.events.agg(F.count(F.when(F.col("value").isNull() | F.isnan("value"), 1)).alias("n_null"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct(F.month("ts")).alias("months")).withColumn("name", F.lit("value"))


@query("q442_reconcile", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'unresolved' WHEN s_suppkey % 10 = 1 THEN 'lat' WHEN s_suppkey % 10 = 2 THEN 'lat,lon' ELSE '' END AS differs FROM supplier")
def reconcile(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 10
    package = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"))
    source = t.supplier.filter(k != 0).select("s_suppkey", (F.col("s_acctbal") + F.when(k.isin(1, 2), 0.01).otherwise(0.0)).alias("lat"), (F.col("s_nationkey") + F.when(k == 2, 0.5).otherwise(0.0001)).alias("lon"))
    return R.reconciled(package, source, "s_suppkey", ["lat", "lon"], 1e-3)


@query("q445_triage", "SELECT o_orderkey, 'UNCERTAIN' AS state, array_to_string(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'coarse date' END, CASE WHEN n > 1 THEN 'repeat' END], lambda x: x IS NOT NULL), ',') AS notes FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def triage(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    notes = X.problems((F.col("o_orderstatus") == "O", "coarse date"), (F.coalesce("n", F.lit(0)) > 1, "repeat"))
    return t.orders.join(n, "o_custkey", "left").select("o_orderkey", F.lit("UNCERTAIN").alias("state"), F.array_join(notes, ",").alias("notes"))


@query("q447_cluster_by_group", "SELECT c_mktsegment AS cluster, count(*) FILTER (c_nationkey % 3 = 0) AS g0, count(*) FILTER (c_nationkey % 3 = 1) AS g1, count(*) FILTER (c_nationkey % 3 = 2) AS g2 FROM customer GROUP BY 1")
def cluster_by_group(t: Tables) -> DataFrame:
    c = t.customer.withColumn("g", F.col("c_nationkey") % 3).groupBy(F.col("c_mktsegment").alias("cluster")).pivot("g", [0, 1, 2])
    return c.count().na.fill(0).withColumnsRenamed({"0": "g0", "1": "g1", "2": "g2"})


@query("q452_log_fields", "SELECT event_id, i::INT AS nth, x AS found FROM (SELECT event_id, regexp_extract_all(props || ' \"k\": 7', '\"k\": (\\d+)', 1) AS xs FROM events), LATERAL (SELECT unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i)")
def log_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.posexplode(F.regexp_extract_all(F.concat("props", F.lit(' "k": 7')), F.lit(r'"k": (\d+)'), F.lit(1))).alias("nth", "found"))


@query("q443_spatial_audit", "SELECT s_suppkey, s_acctbal BETWEEN 0 AND 5000 AS in_box, s_nationkey BETWEEN 5 AND 15 AS in_period, floor(sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey) / 10)::BIGINT AS tens FROM supplier")
def spatial_audit(t: Tables) -> DataFrame:
    d = F.sqrt(F.col("s_acctbal") * F.col("s_acctbal") + F.col("s_nationkey") * F.col("s_nationkey"))
    return t.supplier.select("s_suppkey", F.col("s_acctbal").between(0, 5000).alias("in_box"), F.col("s_nationkey").between(5, 15).alias("in_period"), F.floor(d / 10).alias("tens"))


@query("q428_verified_approvals", "SELECT o_custkey AS record FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F' AND o_totalprice > 20000) AND NOT bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def approvals(t: Tables) -> DataFrame:
    """Records covered by sign-offs on checked decisions, without those a later change revoked."""
    signed = t.orders.filter("o_orderstatus = 'F' AND o_totalprice > 20000").select(F.col("o_custkey").alias("record")).distinct()
    changed = t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("record"))
    return signed.join(changed, "record", "left_anti")


@query("q429_uncovered_eras", "SELECT array_to_string(list_sort(list(DISTINCT year(o_orderdate)::VARCHAR)), ',') AS eras FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F' AND o_totalprice > 20000) AND NOT bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'))")
def uncovered(t: Tables) -> DataFrame:
    open_ = t.orders.join(approvals(t), F.col("o_custkey") == F.col("record"), "left_anti")
    return open_.agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("eras"))


@query("q436_single_exposure", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, n - k AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (o_totalprice > 30000) OVER (PARTITION BY o_custkey) AS k FROM orders) WHERE r = 1")
def single_exposure(t: Tables) -> DataFrame:
    """A unit's earliest member stands for it; dropped counts its members that the guard takes out."""
    g = t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") > 30000, 1)).alias("k"))
    return g.select("o_custkey", "m.o_orderkey", F.round("m.o_totalprice", 2).alias("price"), (F.col("n") - F.col("k")).alias("dropped"))


@query("q357_rollup_with_lookup", "SELECT l_orderkey, count(*) AS members, count(p_partkey) AS known, max(p_brand) AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY 1")
def rollup_lookup(t: Tables) -> DataFrame:
    rows = t.part.filter("p_size > 10").select("p_partkey", "p_brand")
    return t.lineitem.join(rows, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("members"), F.count("p_partkey").alias("known"), F.max("p_brand").alias("brand"))


@query("q172_crosswalk_summary", "SELECT o_orderstatus AS class, count(*) AS n, count(DISTINCT o_custkey) AS ids, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY 1")
def crosswalk(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("ids"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).alias("large"))


@query("q345_feasibility", "SELECT n AS records, m AS verified, round(m / n, 6) AS share, CASE WHEN m >= 30 AND m / n >= 0.1 THEN 'FEASIBLE' ELSE 'NOT_FEASIBLE' END AS verdict FROM (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS m FROM orders)")
def feasibility(t: Tables) -> DataFrame:
    d = t.orders.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("verified"))
    share = F.col("verified") / F.col("records")
    return d.select("records", "verified", F.round(share, 6).alias("share"), F.when((F.col("verified") >= 30) & (share >= 0.1), "FEASIBLE").otherwise("NOT_FEASIBLE").alias("verdict"))


@query("q376_plan_size", "SELECT sum(l_quantity) AS total, sum(l_quantity) <= 1000000 AS fits FROM lineitem")
def plan_size(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.sum("l_quantity").alias("total")).withColumn("fits", F.col("total") <= 1000000)


@query("q367_coverage_flags", "SELECT *, sum(n) OVER (PARTITION BY epoch)::BIGINT AS slots FROM (SELECT year(o_orderdate)::INT AS epoch, o_orderstatus AS flag, count(*) AS n FROM orders GROUP BY 1, 2)")
def coverage_flags(t: Tables) -> DataFrame:
    c = t.orders.groupBy(F.year("o_orderdate").alias("epoch"), F.col("o_orderstatus").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("slots", F.sum("n").over(Window.partitionBy("epoch")))
