"""Reports that bring several operators together: change points, matched composites, alignments, silhouettes, coherence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import models as M
from panelforge.operators import order as O
from panelforge.operators import resample as R
from panelforge.operators import signal as G
from panelforge.plans.panels import EVENT_SQL, UNIT_SQL, event_days, unit_daily
from panelforge.plans.registry import Tables, query
from panelforge.plans.spatial import DRAW_SQL, draw

HALF, LEAST_REF, DRAWS, REST = 10, 20, 200, 7


@query("q267_change_report")
def change_report(t: Tables) -> DataFrame:
    """Change points of two methods on two monthly series a unit, and whether any falls into the window of interest."""
    monthly = unit_daily(t).groupBy("unit", F.trunc("day", "month").alias("month")).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).cast("double").alias("days"))
    found = None
    for series in ("mean", "days"):
        for method, places in (("cusum", lambda x: M.cusum(x, 0.5, 5.0, REST)), ("segments", lambda x: M.segments(x, 0.5))):
            one = M.per_series(monthly, ["unit"], "month", series, places).withColumns({"series": F.lit(series), "method": F.lit(method)})
            found = one if found is None else found.unionByName(one)
    inside = F.col("month").between(F.lit("1997-06-01").cast("date"), F.lit("1997-12-31").cast("date"))
    told = found.groupBy("unit", "series", "method").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("month")).alias("months"), F.bool_or(inside).alias("in_window"))
    spine = monthly.select("unit").distinct().crossJoin(F.broadcast(t.spark.createDataFrame([(s, m) for s in ("mean", "days") for m in ("cusum", "segments")], "series string, method string")))
    out = spine.join(told, ["unit", "series", "method"], "left")
    return out.select("unit", "series", "method", F.coalesce("n", F.lit(0)).alias("n"), F.array_join(F.coalesce("months", F.array().cast("array<date>")).cast("array<string>"), ",").alias("months"), F.coalesce("in_window", F.lit(False)).alias("in_window"))


@query("q359_matched_composite", f"""WITH {UNIT_SQL}, {EVENT_SQL}, w AS (SELECT unit, d + i AS day, v FROM (SELECT unit, day AS d, v, unnest(range(7))::INT AS i FROM unit_daily)), r AS (SELECT unit, day, avg(v) AS v FROM w GROUP BY 1, 2 HAVING count(*) = 7),
    ok AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.unit = r.unit AND abs(r.day - event_day) <= {REST})), x AS (SELECT e.unit, event_day, r.v, dayofyear(event_day - 1) AS doy FROM e JOIN r ON r.unit = e.unit AND r.day = event_day - 1),
    p AS (SELECT x.unit, x.event_day, x.v, ok.day, ok.v AS ref FROM x JOIN ok ON ok.unit = x.unit AND least(abs(dayofyear(ok.day) - x.doy), 366 - abs(dayofyear(ok.day) - x.doy)) <= {HALF}),
    s AS (SELECT unit, event_day, any_value(v) AS v, count(*) AS n, avg(ref) AS mu, stddev_pop(ref) AS sd FROM p GROUP BY 1, 2 HAVING count(*) >= {LEAST_REF} AND stddev_pop(ref) > 0), z AS (SELECT unit, event_day, n, mu, sd, (v - mu) / sd AS z FROM s),
    q AS (SELECT p.unit, p.event_day, (ref - mu) / sd AS zr, row_number() OVER (PARTITION BY p.unit, p.event_day ORDER BY day) - 1 AS i FROM p JOIN z ON z.unit = p.unit AND z.event_day = p.event_day),
    d AS (SELECT k, avg(zr) AS m FROM (SELECT r AS k, z.unit, z.event_day, floor({DRAW_SQL.format("r || '|' || z.unit || '|' || z.event_day")} * n)::BIGINT AS i FROM z, range({DRAWS}) g(r)) JOIN q USING (unit, event_day, i) GROUP BY 1)
    SELECT n, round(mean_z, 6) AS mean_z, n_pos, round((1 + count(*) FILTER (m >= mean_z)) / {DRAWS + 1}, 6) AS p_upper, round(least(1, 2 * least(1 + count(*) FILTER (m >= mean_z), 1 + count(*) FILTER (m <= mean_z)) / {DRAWS + 1}), 6) AS p_two, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high
    FROM d, (SELECT count(*) AS n, avg(z) AS mean_z, count(*) FILTER (z > 0) AS n_pos FROM z) GROUP BY n, mean_z, n_pos""")
def matched_composite(t: Tables) -> DataFrame:
    """Weeks before events as z scores against the unit's weeks of the same time of year, away from events, and the mean of
    all against means of one random such week each."""
    daily, e = unit_daily(t), event_days(t)
    sent = daily.select("unit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add("day", i))).alias("day"), "v")
    week = sent.groupBy("unit", "day").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("c")).filter("c = 7").drop("c")
    washed = e.select("unit", F.explode(F.transform(F.sequence(F.lit(-REST), F.lit(REST)), lambda i: F.date_add("event_day", i))).alias("day"))
    ref = week.join(washed, ["unit", "day"], "left_anti").select("unit", "day", F.col("v").alias("ref"), F.dayofyear("day").alias("doy"))
    x = e.join(week, (e.unit == week.unit) & (F.date_sub(e.event_day, 1) == week.day)).select(e.unit, "event_day", "v", F.dayofyear(F.date_sub("event_day", 1)).alias("own"))
    # days of the year within HALF, around the year of 366; each once
    near = F.array_distinct(F.transform(F.sequence(F.lit(-HALF), F.lit(HALF)), lambda i: F.pmod(F.col("own") - 1 + i, F.lit(366)) + 1))
    pool = x.select("unit", "event_day", "v", F.explode(F.array_union(near, F.array(F.col("own")))).alias("doy")).join(ref, ["unit", "doy"])
    key = ["unit", "event_day"]
    z = pool.groupBy(*key).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.avg("ref").alias("mu"), F.stddev_pop("ref").alias("sd")).filter((F.col("n") >= LEAST_REF) & (F.col("sd") > 0))
    z = O.checkpointed(z.select(*key, "n", "mu", "sd", ((F.col("v") - F.col("mu")) / F.col("sd")).alias("z")))
    placed = O.running(pool.select(*key, "day", "ref", F.lit(1).cast("long").alias("one")), key, ["day"], "one", "k").join(z, key).select(*key, ((F.col("ref") - F.col("mu")) / F.col("sd")).alias("zr"), (F.col("k") - 1).alias("i"))
    drawn = R.replicated(z, DRAWS).select("replicate", *key, F.floor(draw(F.col("replicate"), F.col("unit"), F.col("event_day")) * F.col("n")).alias("i"))
    means = drawn.join(placed, [*key, "i"]).groupBy("replicate").agg(F.avg("zr").alias("m"))
    seen = z.agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.count_if(F.col("z") > 0).alias("n_pos"))
    c = means.join(F.broadcast(seen)).groupBy("n", "mean_z", "n_pos").agg((1 + F.count_if(F.col("m") >= F.col("mean_z"))).alias("up"), (1 + F.count_if(F.col("m") <= F.col("mean_z"))).alias("down"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    two = F.least(F.lit(1.0), 2 * F.least("up", "down") / (DRAWS + 1))
    return c.select("n", F.round("mean_z", 6).alias("mean_z"), "n_pos", F.round(F.col("up") / (DRAWS + 1), 6).alias("p_upper"), F.round(two, 6).alias("p_two"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


_COV_SQL = """c AS (SELECT p_type AS component, count(*) AS n, covar_pop(p_size, p_size) AS aa, covar_pop(p_size, p_retailprice) AS ab, covar_pop(p_retailprice, p_retailprice) AS bb FROM part GROUP BY 1), t AS (SELECT sum(n * aa) / sum(n) AS aa, sum(n * ab) / sum(n) AS ab, sum(n * bb) / sum(n) AS bb FROM c),
    m AS (SELECT 'full' AS family, component, aa, ab, bb FROM c UNION ALL SELECT 'tied', component, t.aa, t.ab, t.bb FROM c, t UNION ALL SELECT 'diag', component, aa, 0, bb FROM c UNION ALL SELECT 'spherical', component, (aa + bb) / 2, 0, (aa + bb) / 2 FROM c)"""


@query("q486_covariance_expansion", f"WITH {_COV_SQL} SELECT family, component, unnest([0, 0, 1, 1])::INT AS i, unnest([0, 1, 0, 1])::INT AS j, round(unnest([aa, ab, ab, bb]), 4) AS value FROM m")
def covariance_expansion(t: Tables) -> DataFrame:
    """The covariance of every component as a full matrix in long form, whatever its family shares or leaves out."""
    c = t.part.groupBy(F.col("p_type").alias("component")).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("p_size", "p_size").alias("aa"), F.covar_pop("p_size", "p_retailprice").alias("ab"), F.covar_pop("p_retailprice", "p_retailprice").alias("bb"))
    return M.full_covariances(c, "component", "n", [["aa", "ab"], ["ab", "bb"]]).withColumn("value", F.round("value", 4))


@query("q251_silhouette", """WITH x AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 40 AS b FROM part), l AS (SELECT *, (SELECT arg_min(k, (a - u) * (a - u) + (b - v) * (b - v)) FROM (VALUES (0, 10.3::DOUBLE, 30.1::DOUBLE), (1, 40.1, 30.7), (2, 25.2, 45.9)) c(k, u, v)) AS c FROM x),
    d AS (SELECT p.p_partkey, p.c AS own, q.c AS c, sum(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))) AS s, count(*) AS n FROM l p, l q GROUP BY 1, 2, 3), a AS (SELECT p_partkey, max(CASE WHEN c = own THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN c = own THEN n END) AS n, min(CASE WHEN c <> own THEN s / n END) AS b FROM d GROUP BY 1)
    SELECT round(avg(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS n FROM a""")
def silhouette(t: Tables) -> DataFrame:
    """The mean silhouette of all parts about three given centres; null without parts."""
    centres = np.array([[10.3, 30.1], [40.1, 30.7], [25.2, 45.9]])
    points = O.checkpointed(t.part.select(F.col("p_partkey").cast("long").alias("key"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 40).alias("x")))
    score = M.silhouettes(points, {3: centres})[3]
    return points.agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(score).cast("double"), 6).alias("silhouette"), "n")


_MEANS_SQL = "m AS (SELECT p_brand, p_size % 3 AS g, avg(p_size)::DOUBLE / 10 AS a, avg(p_retailprice) / 300 AS b FROM part GROUP BY 1, 2), r AS (SELECT p_type, p_size % 3 AS g, avg(p_size)::DOUBLE / 10 AS a, avg(p_retailprice) / 300 AS b FROM part GROUP BY 1, 2)"


@query("q252_component_alignment", f"""WITH {_MEANS_SQL}, x AS (SELECT DISTINCT p_brand, p_type FROM part), k AS (SELECT p_brand FROM m GROUP BY 1 HAVING count(*) = 3), f AS (SELECT p_type FROM r GROUP BY 1 HAVING count(*) = 3),
    c AS (SELECT x.p_brand, x.p_type, r.g AS i, m.g AS j, (m.a - r.a) * (m.a - r.a) + (m.b - r.b) * (m.b - r.b) AS d FROM x JOIN k USING (p_brand) JOIN f USING (p_type) JOIN m USING (p_brand) JOIN r USING (p_type)),
    o AS (SELECT p.p_brand, p.p_type, p.j AS a, q.j AS b, s.j AS c, p.d + q.d + s.d AS cost FROM c p JOIN c q ON q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.i = 1 JOIN c s ON s.p_brand = p.p_brand AND s.p_type = p.p_type AND s.i = 2 WHERE p.i = 0 AND p.j <> q.j AND p.j <> s.j AND q.j <> s.j)
    SELECT p_brand, p_type, first(a || ',' || b || ',' || c ORDER BY round(cost, 12), a, b, c) AS alignment FROM o GROUP BY 1, 2""")
def alignment(t: Tables) -> DataFrame:
    """The order of a brand's three group means that lies nearest to those of each of its types."""
    mean = lambda key: t.part.groupBy(key, (F.col("p_size") % 3).alias("g")).agg((F.avg("p_size") / 10).alias("a"), (F.avg("p_retailprice") / 300).alias("b")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("g", "a", "b"))).alias(f"m_{key}")).filter(F.size(f"m_{key}") == 3)
    both = t.part.select("p_brand", "p_type").distinct().join(mean("p_brand"), "p_brand").join(mean("p_type"), "p_type")

    def nearest(batches):
        for pdf in batches:
            at = lambda rows: np.array([[r["a"], r["b"]] for r in rows])
            told = [",".join(map(str, M.aligned(at(ref), at(own)))) for ref, own in zip(pdf["m_p_type"], pdf["m_p_brand"], strict=True)]
            yield pd.DataFrame({"p_brand": pdf["p_brand"], "p_type": pdf["p_type"], "alignment": told})

    return both.mapInPandas(nearest, "p_brand string, p_type string, alignment string")


@query("q307_coherence")
def coherence(t: Tables) -> DataFrame:
    """Coherence by band of each two units' weekly sums, half-year by half-year, where both have every one of its 26 weeks."""
    weekly = unit_daily(t).groupBy("unit", F.floor(F.datediff("day", F.lit("1970-01-05")) / 7).alias("week")).agg(F.sum("v").alias("v"))
    half = weekly.groupBy("unit", F.floor(F.col("week") / 26).alias("half")).agg(F.array_sort(F.collect_list(F.struct("week", "v"))).alias("s")).filter(F.size("s") == 26)
    half = half.select("unit", F.date_add(F.lit("1970-01-05").cast("date"), (F.col("half") * 182).cast("int")).alias("start"), F.transform("s", lambda x: x["v"]).alias("x"))
    pair = half.alias("p").join(half.alias("q"), (F.col("p.start") == F.col("q.start")) & (F.col("p.unit") < F.col("q.unit")))
    pair = pair.select(F.col("p.unit").alias("a"), F.col("q.unit").alias("b"), F.col("p.start").alias("start"), F.col("p.x").alias("xa"), F.col("q.x").alias("xb"))
    return G.coherent(pair, ["a", "b", "start"], "xa", "xb", 20.0, 3).select("a", "b", "start", *[F.round(c, 8).alias(c) for c in ("low", "mid", "high")])
