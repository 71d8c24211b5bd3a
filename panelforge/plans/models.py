"""Queries on models and resampling: seeded or iterative, so checked by tests instead of SQL where they must be."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import models as M
from panelforge.operators import resample as R
from panelforge.operators import signal as G
from panelforge.plans.panels import daily_orders, unit_daily
from panelforge.plans.registry import Tables, query


@query("q202_cusum")
def cusum(t: Tables) -> DataFrame:
    return M.per_series(unit_daily(t), ["unit"], "day", "v", lambda x: M.cusum(x, 0.5, 5.0, 10))


@query("q266_segments")
def change_points(t: Tables) -> DataFrame:
    monthly = unit_daily(t).groupBy("unit", F.trunc("day", "month").alias("month")).agg(F.avg("v").alias("v"))
    return M.per_series(monthly, ["unit"], "month", "v", lambda x: M.segments(x, 0.5))


@query("q242_mixture_sweep")
def sweep(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    return M.mixture_sweep(x, "p_partkey", ["a", "b"], [1, 2, 3, 4, 5], [11, 12, 13]).withColumns({"bic": F.round("bic", 2), "aic": F.round("aic", 2)})


@query("q265_isolation_forest")
def forest(t: Tables) -> DataFrame:
    x = daily_orders(t).select("day", "v", F.col("n").cast("double").alias("n"), F.year("day").alias("year"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        points = pdf[["v", "n"]].to_numpy(float)
        scores = M.isolation_scores(points, points, 200, 128, 7)
        return pd.DataFrame({"day": pdf["day"], "score": np.round(scores, 6), "anomaly": scores > np.percentile(scores, 99)})

    return x.groupBy("year").applyInPandas(score, "day date, score double, anomaly boolean")


@query("q270_group_bootstrap")
def bootstrap(t: Tables) -> DataFrame:
    r = M.bootstrap_sums(t.orders, "o_custkey", F.col("o_totalprice"), 200, 5)
    q = r.filter("n > 0").select((F.col("total") / F.col("n")).alias("m")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(*[F.round(F.col("q")[i], 3).alias(name) for i, name in enumerate(("low", "median", "high"))])


@query("q255_column_shuffle", "SELECT count(*) AS n, round(sum(p_size)::DOUBLE, 4) AS sizes, round(sum(p_retailprice), 2) AS prices FROM part")
def column_shuffle(t: Tables) -> DataFrame:
    x = R.column_shuffle(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], 9)
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_size").cast("double"), 4).alias("sizes"), F.round(F.sum("p_retailprice"), 2).alias("prices"))


@query("q291_label_shuffle_null")
def label_shuffle(t: Tables) -> DataFrame:
    c = t.labels.filter("quality IS NOT NULL").select("doc_id", (F.col("doc_id") % 4).alias("stratum"), "quality", "toxic")
    real = c.filter("toxic = 1").agg(F.avg("quality").alias("observed"))
    null = R.label_shuffle(c, ["stratum"], "doc_id", "quality", 100, 3).filter("toxic = 1").groupBy("replicate").agg(F.avg("quality").alias("m"))
    return null.join(F.broadcast(real)).groupBy("observed").agg(F.avg((F.col("m") >= F.col("observed")).cast("double")).alias("p"), F.count(F.lit(1)).alias("replicates"))


@query("q268_block_permutation", """WITH d AS (SELECT l_returnflag AS unit, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day) AS i FROM d),
    tg AS (SELECT unit, avg(v) AS observed, count(*) AS size FROM d WHERE day BETWEEN DATE '1997-06-01' AND DATE '1997-08-31' GROUP BY 1),
    b AS (SELECT a.unit, a.i, tg.observed, avg(x.v) AS m FROM n a JOIN tg USING (unit) JOIN n x ON x.unit = a.unit AND x.i BETWEEN a.i - tg.size + 1 AND a.i WHERE a.i >= tg.size AND (a.day < DATE '1997-06-01' OR a.day - 91 > DATE '1997-08-31') GROUP BY ALL)
    SELECT unit, round(observed, 6) AS observed, count(*) AS blocks, round(avg((m >= observed)::INT), 8) AS p FROM b GROUP BY 1, 2""")
def block_permutation(t: Tables) -> DataFrame:
    r = R.block_permutation(unit_daily(t), "unit", "day", "v", "1997-06-01", "1997-08-31")
    return r.select("unit", F.round("observed", 6).alias("observed"), "blocks", F.round("p", 8).alias("p"))


@query("q271_sign_test", """WITH c AS (SELECT o_custkey, count(*) FILTER (o_totalprice > 250000) AS k, count(*) AS n FROM orders GROUP BY 1),
    f AS (SELECT o_custkey, k, n, unnest(range(0, least(k, n - k) + 1)) AS i FROM c) SELECT o_custkey, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))), 8) AS p FROM f GROUP BY 1""")
def sign_test(t: Tables) -> DataFrame:
    c = t.orders.groupBy("o_custkey").agg(F.count(F.when(F.col("o_totalprice") > 250000, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return R.sign_tests(c, "k", "n").select("o_custkey", F.round("p", 8).alias("p"))


@query("q295_calibration_fit")
def calibration_fit(t: Tables) -> DataFrame:
    from panelforge.plans.metrics import cases

    a, b = R.calibration_fit(cases(t), "y", "p")
    return t.spark.range(1).select(F.lit(round(a, 6)).alias("slope"), F.lit(round(b, 6)).alias("intercept"))


@query("q272_kmeans_best_k")
def best_k(t: Tables) -> DataFrame:
    return M.kmeans_sweep(t.embeddings, "vec_id", "embedding", [2, 3, 4, 5, 6], 1).withColumns({"silhouette": F.round("silhouette", 6), "inertia": F.round("inertia", 4)})


@query("q306_window_features")
def window_features(t: Tables) -> DataFrame:
    hourly = t.events.groupBy((F.col("event_id") * 0).alias("unit"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.avg("value").alias("v"))
    day = G.tiles(hourly, "unit", "hour", "v", 86400, 24).withColumn("rate", F.lit(24.0))
    f = G.featured(day, ["unit", "start"], "samples", "rate")
    return f.select("unit", F.col("start").cast("timestamp_ntz").alias("start"), *[F.round(c, 8).alias(c) for c in G.FEATURES])
