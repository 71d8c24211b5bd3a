"""Queries on dated panels: daily aggregation, rolling windows, spells, calendar-band statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import order as O
from panelforge.operators import windows as W
from panelforge.plans.registry import Tables, query

DAILY_SQL = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)"


def daily_orders(t: Tables, first: str | None = None, before: str | None = None) -> DataFrame:
    """Daily means; the bounds are on the stored column, so they reach the scan."""
    rows = t.orders
    rows = rows if first is None else rows.filter(F.col("o_orderdate") >= first)
    rows = rows if before is None else rows.filter(F.col("o_orderdate") < before)
    return rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))


@query("q128_daily_mean", f"WITH {DAILY_SQL} SELECT day, round(v, 6) AS mean_value, n FROM daily")
def daily_mean(t: Tables) -> DataFrame:
    return daily_orders(t).select("day", F.round("v", 6).alias("mean_value"), "n")


@query("q129_daily_sum_null_preserving", "SELECT CAST(ts AS DATE) AS day, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def daily_sum(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("q130_accumulation_day", "SELECT CAST(CASE WHEN hour(ts) = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS DATE) AS day, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def accumulation_day(t: Tables) -> DataFrame:
    return t.events.groupBy(W.daily_key("ts", accumulated=True).alias("day")).agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("q131_running_total_detector", """
    WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, value FROM events),
    d AS (SELECT user_id, day, min_by(value, (ts, event_id)) AS opening, max_by(value, (ts, event_id)) AS closing FROM r GROUP BY 1, 2),
    p AS (SELECT *, lag(closing) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d)
    SELECT user_id, count(*) AS days, round(avg((closing >= opening)::INT), 6) AS rising, round(avg((opening < before)::INT), 6) AS resets,
           coalesce(avg((closing >= opening)::INT) >= 0.9 AND avg((opening < before)::INT) >= 0.5, FALSE) AS running
    FROM p GROUP BY 1""")
def running_total(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("opening"), F.max_by("value", F.struct("ts", "event_id")).alias("closing"))
    p = d.withColumn("before", F.lag("closing").over(Window.partitionBy("user_id").orderBy("day")))
    rising, resets = F.avg((F.col("closing") >= F.col("opening")).cast("int")), F.avg((F.col("opening") < F.col("before")).cast("int"))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.round(rising, 6).alias("rising"), F.round(resets, 6).alias("resets"), F.coalesce((rising >= 0.9) & (resets >= 0.5), F.lit(False)).alias("running"))


@query("q132_closing_value", "SELECT user_id, CAST(ts AS DATE) AS day, round(max_by(value, (ts, event_id)), 4) AS closing, count(DISTINCT hour(ts)) < 24 AS partial FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def closing_value(t: Tables) -> DataFrame:
    return t.events.filter("value IS NOT NULL").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.max_by("value", F.struct("ts", "event_id")), 4).alias("closing"), (F.count_distinct(F.hour("ts")) < 24).alias("partial"))


@query("q133_circular_mean", "SELECT CAST(ts AS DATE) AS day, round(avg(sin(radians(value))), 8) AS mean_sin, round(avg(cos(radians(value))), 8) AS mean_cos FROM events GROUP BY 1")
def circular_mean(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg(F.sin(F.radians("value"))), 8).alias("mean_sin"), F.round(F.avg(F.cos(F.radians("value"))), 8).alias("mean_cos"))


@query("q134_complete_days", "SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) = 24")
def complete_days(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count_distinct(F.hour("ts")).alias("h"))
    return g.filter("h = 24").drop("h")


@query("q135_conflicting_duplicates", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(DISTINCT o_totalprice) AS different FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_totalprice) > 1")
def conflicts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_totalprice").alias("different")).filter("different > 1")


@query("q136_masked_mean", "SELECT l_suppkey, CASE WHEN avg((l_discount <= 0.09)::INT) >= 0.9 THEN round(avg(CASE WHEN l_discount <= 0.09 THEN l_extendedprice END), 6) END AS masked_mean, round(avg((l_discount <= 0.09)::INT), 6) AS valid FROM lineitem GROUP BY 1")
def masked_mean(t: Tables) -> DataFrame:
    ok = F.col("l_discount") <= 0.09
    share = F.avg(ok.cast("int"))
    return t.lineitem.groupBy("l_suppkey").agg(F.when(share >= 0.9, F.round(F.avg(F.when(ok, F.col("l_extendedprice"))), 6)).alias("masked_mean"), F.round(share, 6).alias("valid"))


@query("q137_day_of_year_climatology", f"WITH {DAILY_SQL} SELECT CAST(dayofyear(day) AS INT) AS doy, round(avg(v), 6) AS mean_value, round(stddev_samp(v), 5) AS spread, count(*) AS years FROM daily GROUP BY 1")
def climatology(t: Tables) -> DataFrame:
    return daily_orders(t).groupBy(F.dayofyear("day").alias("doy")).agg(F.round(F.avg("v"), 6).alias("mean_value"), F.round(F.stddev_samp("v"), 5).alias("spread"), F.count(F.lit(1)).alias("years"))


RUNS_SQL = f"{DAILY_SQL}, lagged AS (SELECT *, coalesce((day - lag(day) OVER (ORDER BY day) <> 1)::INT, 1) AS gap FROM daily), runs AS (SELECT *, sum(gap) OVER (ORDER BY day) AS run FROM lagged)"


@query("q183_rolling_within_runs", f"""WITH {RUNS_SQL} SELECT day, CASE WHEN count(v) OVER w = 7 THEN round(sum(v) OVER w, 5) END AS rolled, count(v) OVER w < 7 AS edge_censored
    FROM runs WINDOW w AS (PARTITION BY run ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_runs(t: Tables) -> DataFrame:
    r = W.rolling(daily_orders(t).withColumn("unit", F.lit(1)), ["unit"], "day", "v", 7)
    return r.select("day", F.round("rolled", 5).alias("rolled"), F.col("rolled").isNull().alias("edge_censored"))


UNIT_SQL = "unit_daily AS (SELECT l_returnflag AS unit, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def unit_daily(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("unit"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))


#: Event days by the panel alone: a unit's days more than two standard deviations over its mean.
EVENT_SQL = "e AS (SELECT unit, day AS event_day FROM (SELECT *, avg(v) OVER u AS m, stddev_samp(v) OVER u AS s FROM unit_daily WINDOW u AS (PARTITION BY unit)) WHERE v > m + 2 * s)"


def event_days(t: Tables) -> DataFrame:
    daily = unit_daily(t)
    m = daily.groupBy("unit").agg((F.avg("v") + 2 * F.stddev_samp("v")).alias("least"))
    return daily.join(F.broadcast(m), "unit").filter("v > least").select("unit", F.col("day").alias("event_day"))


@query("q185_rolling_mean_and_change", f"""WITH {UNIT_SQL}, l AS (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY unit ORDER BY day) <> 1)::INT, 1) AS gap FROM unit_daily),
    r AS (SELECT *, sum(gap) OVER (PARTITION BY unit ORDER BY day) AS run FROM l)
    SELECT unit, day, CASE WHEN count(v) OVER w = 7 THEN round(avg(v) OVER w, 4) END AS mean7, round(v - lag(v, 3) OVER (PARTITION BY unit, run ORDER BY day), 4) AS change3
    FROM r WINDOW w AS (PARTITION BY unit, run ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_change(t: Tables) -> DataFrame:
    r = W.with_runs(W.rolling(unit_daily(t), ["unit"], "day", "v", 7, "mean", "m"), ["unit"], "day")
    before = F.lag("v", 3).over(Window.partitionBy("unit", "run_id").orderBy("day"))
    return r.select("unit", "day", F.round("m", 4).alias("mean7"), F.round(F.col("v") - before, 4).alias("change3"))


@query("q186_rolling_partial", f"WITH {UNIT_SQL} SELECT unit, day, round(sum(v) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolled FROM unit_daily")
def rolling_partial(t: Tables) -> DataFrame:
    r = W.rolling(unit_daily(t), ["unit"], "day", "v", 7, gaps=True)
    return r.select("unit", "day", F.round("rolled", 4).alias("rolled"))


@query("q140_spells", f"""WITH {UNIT_SQL}, h AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY unit ORDER BY day) AS INT) AS island FROM unit_daily WHERE v > 200)
    SELECT unit, min(day) AS "start", max(day) AS "end", count(*) AS length FROM h GROUP BY unit, island HAVING count(*) >= 2""")
def wet_spells(t: Tables) -> DataFrame:
    return W.spells(unit_daily(t), ["unit"], "day", F.col("v") > 200, 2)


@query("q139_longest_run", f"""WITH {UNIT_SQL}, h AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY unit ORDER BY day) AS INT) AS island FROM unit_daily WHERE v > 200),
    s AS (SELECT unit, min(day) AS first_day, count(*) AS length FROM h GROUP BY unit, island) SELECT unit, CAST(year(first_day) AS INT) AS year, max(length) AS longest, count(*) AS spells, round(avg(length), 6) AS mean_length FROM s GROUP BY 1, 2""")
def longest_run(t: Tables) -> DataFrame:
    s = W.spells(unit_daily(t), ["unit"], "day", F.col("v") > 200)
    return s.groupBy("unit", F.year("start").alias("year")).agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("spells"), F.round(F.avg("length"), 6).alias("mean_length"))


@query("q138_season_aggregate", f"""WITH {UNIT_SQL} SELECT unit, CAST(year(day) AS INT) AS year, round(avg(v), 6) AS mean_value, round(sum(greatest(v - 100, 0)), 4) AS degree_sum, round(quantile_cont(v, 0.95), 6) AS q95, round(max_by(v, day) - min_by(v, day), 4) AS delta, count(*) AS days
    FROM unit_daily WHERE month(day) IN (6, 7, 8) GROUP BY 1, 2""")
def season_aggregate(t: Tables) -> DataFrame:
    jja = unit_daily(t).filter(F.month("day").isin(6, 7, 8))
    return jja.groupBy("unit", F.year("day").alias("year")).agg(F.round(F.avg("v"), 6).alias("mean_value"), F.round(F.sum(F.greatest(F.col("v") - 100, F.lit(0.0))), 4).alias("degree_sum"), F.round(F.percentile("v", 0.95), 6).alias("q95"), F.round(F.max_by("v", "day") - F.min_by("v", "day"), 4).alias("delta"), F.count(F.lit(1)).alias("days"))


ZSCORE_SQL = f"""{DAILY_SQL}, target AS (SELECT * FROM daily WHERE year(day) = 2000), base AS (SELECT * FROM daily WHERE year(day) < 2000),
    scored AS (SELECT t.day, t.v, count(b.v) AS n, avg(b.v) AS m, stddev_samp(b.v) AS s FROM target t LEFT JOIN base b ON abs(dayofyear(b.day) - dayofyear(t.day)) <= 3 GROUP BY 1, 2)"""


def target_and_base(t: Tables) -> tuple[DataFrame, DataFrame]:
    one = F.lit(1)
    return daily_orders(t, "2000-01-01", "2001-01-01").withColumn("unit", one), daily_orders(t, None, "2000-01-01").withColumn("unit", one)


def zscores(t: Tables) -> DataFrame:
    target, base = target_and_base(t)
    m = W.doy_moments(target, base, ["unit"], "day", "v", 3)
    return m.withColumn("z", W.zscore(F.col("v"), F.col("base_mean"), F.col("base_std"), F.col("base_n"), 5, 0.0))


@query("q187_calendar_zscore", f"WITH {ZSCORE_SQL} SELECT day, n AS base_n, CASE WHEN n >= 5 THEN CASE WHEN s = 0 THEN 0.0 ELSE round((v - m) / s, 6) END END AS z, coalesce(n >= 5 AND abs((v - m) / s) > 2, FALSE) AS unusual FROM scored")
def calendar_zscore(t: Tables) -> DataFrame:
    return zscores(t).select("day", F.coalesce("base_n", F.lit(0)).alias("base_n"), F.round("z", 6).alias("z"), F.coalesce(F.abs("z") > 2, F.lit(False)).alias("unusual"))


@query("q143_negative_control_counts", f"WITH {ZSCORE_SQL} SELECT CAST(month(day) AS INT) AS month, count(*) FILTER (n >= 5 AND abs((v - m) / s) > 2) AS beyond_two, round(max(abs((v - m) / s)), 6) AS max_abs_z FROM scored GROUP BY 1")
def control_counts(t: Tables) -> DataFrame:
    return zscores(t).groupBy(F.month("day").alias("month")).agg(F.count(F.when(F.abs("z") > 2, 1)).alias("beyond_two"), F.round(F.max(F.abs("z")), 6).alias("max_abs_z"))


@query("q190_percentile_rank_vs_baseline", f"""WITH {DAILY_SQL}, target AS (SELECT * FROM daily WHERE year(day) = 2000), base AS (SELECT * FROM daily WHERE year(day) < 2000)
    SELECT t.day, count(*) AS base_n, round(50.0 * (count(*) FILTER (b.v < t.v) + count(*) FILTER (b.v <= t.v) + (count(*) FILTER (b.v < t.v) < count(*) FILTER (b.v <= t.v))::INT) / count(*), 6) AS percentile
    FROM target t JOIN base b ON abs(dayofyear(b.day) - dayofyear(t.day)) <= 3 GROUP BY t.day""")
def percentile_rank(t: Tables) -> DataFrame:
    target, base = target_and_base(t)
    p = W.doy_pairs(target.select("unit", "day", "v"), base, ["unit"], "day", "v", 3)
    lt, le = F.sum(F.when(F.col("base") < F.col("v"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("base") <= F.col("v"), F.col("n")).otherwise(0))
    return p.groupBy("day").agg(F.sum("n").alias("base_n"), F.round(50.0 * (lt + le + (lt < le).cast("int")) / F.sum("n"), 6).alias("percentile"))


@query("q191_exceedance", f"""WITH {DAILY_SQL}, target AS (SELECT * FROM daily WHERE year(day) = 2000), base AS (SELECT * FROM daily WHERE year(day) < 2000)
    SELECT t.day, round(quantile_cont(b.v, 0.95), 6) AS p95, t.v > quantile_cont(b.v, 0.95) AS above_p95, t.v > quantile_cont(b.v, 0.99) AS above_p99 FROM target t JOIN base b ON abs(dayofyear(b.day) - dayofyear(t.day)) <= 3 GROUP BY t.day, t.v""")
def exceedance(t: Tables) -> DataFrame:
    target, base = target_and_base(t)
    p = W.doy_pairs(target.select("unit", "day", "v"), base, ["unit"], "day", "v", 3)
    g = p.groupBy("day", "v").agg(F.percentile("base", F.array(F.lit(0.95), F.lit(0.99)), F.col("n")).alias("q"))
    return g.select("day", F.round(F.col("q")[0], 6).alias("p95"), (F.col("v") > F.col("q")[0]).alias("above_p95"), (F.col("v") > F.col("q")[1]).alias("above_p99"))


@query("q192_midrank", "SELECT p_partkey, p_brand, round(100.0 * (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + 0.5 * count(*) OVER (PARTITION BY p_brand, p_retailprice)) / count(*) OVER (PARTITION BY p_brand), 8) AS midrank FROM part")
def midrank(t: Tables) -> DataFrame:
    return O.midranks(t.part.select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", "m").select("p_partkey", "p_brand", F.round("m", 8).alias("midrank"))


@query("q199_antecedent_window_all", f"""WITH {UNIT_SQL}, {EVENT_SQL}
    SELECT e.unit, event_day, round(sum(v), 4) AS exposure, round(avg(v), 6) AS mean_value FROM e JOIN unit_daily d ON d.unit = e.unit AND d.day BETWEEN event_day - 10 AND event_day - 4 GROUP BY 1, 2 HAVING count(*) = 7""")
def antecedent_all(t: Tables) -> DataFrame:
    return antecedents(t, event_days(t))


def antecedents(t: Tables, e: DataFrame) -> DataFrame:
    wide = e.withColumn("day", F.explode(F.sequence(F.date_sub("event_day", 10), F.date_sub("event_day", 4))))
    g = wide.join(unit_daily(t), ["unit", "day"]).groupBy("unit", "event_day").agg(F.round(F.sum("v"), 4).alias("exposure"), F.round(F.avg("v"), 6).alias("mean_value"), F.count(F.lit(1)).alias("k"))
    return g.filter("k = 7").drop("k")


@query("q201_linear_detrend", f"WITH {UNIT_SQL}, y AS (SELECT unit, year(day) AS year, avg(v) AS m FROM unit_daily GROUP BY 1, 2) SELECT unit, CAST(year AS INT) AS year, round(m - (regr_slope(m, year) OVER (PARTITION BY unit) * year + regr_intercept(m, year) OVER (PARTITION BY unit)), 4) AS residual FROM y")
def detrend(t: Tables) -> DataFrame:
    y = unit_daily(t).groupBy("unit", F.year("day").alias("year")).agg(F.avg("v").alias("m"))
    fit = y.groupBy("unit").agg(F.regr_slope("m", "year").alias("slope"), F.regr_intercept("m", "year").alias("at_zero"))
    return y.join(fit, "unit").select("unit", "year", F.round(F.col("m") - (F.col("slope") * F.col("year") + F.col("at_zero")), 4).alias("residual"))


@query("q179_cadence", "WITH g AS (SELECT o_custkey, date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS gap FROM orders) SELECT o_custkey, CAST(min(gap) AS INT) AS min_gap, round(quantile_cont(gap, 0.5), 4) AS median_gap, CAST(max(gap) AS INT) AS max_gap, count(gap) AS gaps, coalesce(bool_and(gap % 7 = 0), FALSE) AS weekly FROM g GROUP BY 1")
def cadence(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = t.orders.select("o_custkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap"))
    return g.groupBy("o_custkey").agg(F.min("gap").alias("min_gap"), F.round(F.percentile("gap", 0.5), 4).alias("median_gap"), F.max("gap").alias("max_gap"), F.count("gap").alias("gaps"), F.coalesce(F.bool_and(F.col("gap") % 7 == 0), F.lit(False)).alias("weekly"))


@query("q205_superposed_epoch_all", f"""WITH {UNIT_SQL}, p AS (SELECT *, 100.0 * (rank() OVER (PARTITION BY unit ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY unit, v)) / count(*) OVER (PARTITION BY unit) AS pct FROM unit_daily), {EVENT_SQL}
    SELECT CAST(lag AS INT) AS lag, count(*) AS n, round(avg(pct), 6) AS mean_pct FROM e CROSS JOIN range(-17, 4) r(lag) JOIN p ON p.unit = e.unit AND p.day = event_day + CAST(lag AS INT) GROUP BY 1""")
def superposed_all(t: Tables) -> DataFrame:
    return superposed_on(t, event_days(t))


def superposed_on(t: Tables, e: DataFrame) -> DataFrame:
    p = unit_daily(t).withColumn("pct", W.midrank("v", ["unit"]))
    lags = e.withColumn("lag", F.explode(F.sequence(F.lit(-17), F.lit(3)))).withColumn("day", F.expr("date_add(event_day, lag)"))
    return lags.join(p, ["unit", "day"]).groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pct"), 6).alias("mean_pct"))


@query("q211_seven_day_windows", f"""WITH {DAILY_SQL}, l AS (SELECT day, CASE WHEN v > 150000 THEN 'high' WHEN v > 130000 THEN 'mid' ELSE 'low' END AS label FROM daily),
    w AS (SELECT a.day AS window_start, b.label, b.day FROM l a JOIN l b ON b.day BETWEEN a.day AND a.day + 6), full_w AS (SELECT window_start FROM w GROUP BY 1 HAVING count(*) = 7)
    SELECT window_start, count(*) FILTER (label = 'high') / 7.0 AS high, count(*) FILTER (label = 'mid') / 7.0 AS mid, count(*) FILTER (label = 'low') / 7.0 AS low FROM w JOIN full_w USING (window_start) GROUP BY 1""")
def occupancy_windows(t: Tables) -> DataFrame:
    label = F.when(F.col("v") > 150000, "high").when(F.col("v") > 130000, "mid").otherwise("low")
    d = W.with_runs(daily_orders(t).withColumn("unit", F.lit(1)).withColumn("label", label), ["unit"], "day")
    w = Window.partitionBy("unit", "run_id").orderBy("day").rowsBetween(0, 6)
    share = lambda x: (F.count(F.when(F.col("label") == x, 1)).over(w) / F.lit(7.0)).alias(x)
    return d.select(F.col("day").alias("window_start"), F.count(F.lit(1)).over(w).alias("k"), share("high"), share("mid"), share("low")).filter("k = 7").drop("k")


@query("q206_transition_pairs", f"""WITH {UNIT_SQL}, l AS (SELECT unit, day, CASE WHEN v > 200 THEN 'wet' ELSE 'dry' END AS label FROM unit_daily), p AS (SELECT unit, label, lag(label) OVER w AS before, day - lag(day) OVER w AS gap FROM l WINDOW w AS (PARTITION BY unit ORDER BY day))
    SELECT unit, before, label, count(*) AS n FROM p WHERE gap = 1 GROUP BY ALL""")
def transitions(t: Tables) -> DataFrame:
    w = Window.partitionBy("unit").orderBy("day")
    l = unit_daily(t).withColumn("label", F.when(F.col("v") > 200, "wet").otherwise("dry"))
    p = l.select("unit", "label", F.lag("label").over(w).alias("before"), F.datediff("day", F.lag("day").over(w)).alias("gap"))
    return p.filter("gap = 1").groupBy("unit", "before", "label").agg(F.count(F.lit(1)).alias("n"))


@query("q213_growth_rate", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice) AS a FROM orders GROUP BY 1, 2) SELECT o_custkey, CAST(year AS INT) AS year, round(ln(a / lag(a) OVER w) / (year - lag(year) OVER w), 8) AS rate FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY year) QUALIFY lag(a) OVER w IS NOT NULL")
def growth(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("a"))
    w = Window.partitionBy("o_custkey").orderBy("year")
    r = y.select("o_custkey", "year", F.round(F.ln(F.col("a") / F.lag("a").over(w)) / (F.col("year") - F.lag("year").over(w)), 8).alias("rate"))
    return r.filter("rate IS NOT NULL")


@query("q204_sta_lta", """SELECT event_id, user_id, round(avg(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / nullif(avg(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0), 8) AS ratio FROM events""")
def sta_lta(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    short, long = F.avg(F.abs("value")).over(w.rowsBetween(-4, 0)), F.avg(F.abs("value")).over(w.rowsBetween(-29, 0))
    return t.events.select("event_id", "user_id", F.round(short / F.nullif(long, F.lit(0.0)), 8).alias("ratio"))
