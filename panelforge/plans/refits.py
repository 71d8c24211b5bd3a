"""Queries on how mixtures stand up to refits: folds, strata, calendar blocks, null samples, divergences and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import logistic as L
from panelforge.operators import occupancy as O
from panelforge.operators import refits as R
from panelforge.operators import stability as C
from panelforge.operators.order import checkpointed
from panelforge.plans.registry import Tables, query

FEATURES = ["price", "orders", "urgent"]
SEEDS = [11, 12, 13]


def weekly(t: Tables) -> DataFrame:
    """One row for each market segment and week: mean order value, orders and the share of urgent ones, with its strata.

    The rows are kept: read again, the means could differ in their last places, as sums depend on the order of their parts.
    """
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    p = o.groupBy("segment", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(
        (F.avg("o_totalprice") / 100000).alias("price"), F.count(F.lit(1)).cast("double").alias("orders"), F.avg((F.substring("o_orderpriority", 1, 1) <= "2").cast("double")).alias("urgent")
    )
    season = F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), (F.floor((F.month("week") % 12) / 3) + 1).cast("int"))
    era = F.when(F.year("week") < 1998, "early").otherwise("late")
    return checkpointed(p.select("*", F.xxhash64("segment", "week").alias("id"), season.alias("season"), era.alias("era"), F.when(F.col("price") < 1.4, "low").otherwise("high").alias("band"), F.when(F.col("orders") < 5, "thin").otherwise("thick").alias("effort")))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("q254_fold_refits")
def fold_refits(t: Tables) -> DataFrame:
    return rounded(R.group_refits(weekly(t), "id", "era", FEATURES, [1, 2, 3], SEEDS, False))


@query("q259_leave_one_group_out_refits")
def left_out_refits(t: Tables) -> DataFrame:
    return rounded(R.group_refits(weekly(t), "id", "segment", FEATURES, [1, 2, 3], SEEDS, True))


@query("q261_axis_refits")
def axis_refits(t: Tables) -> DataFrame:
    return rounded(R.axis_refits(weekly(t), "id", ["season", "band", "effort"], FEATURES, [1, 2, 3], SEEDS))


@query("q258_block_refits")
def block_refits(t: Tables) -> DataFrame:
    return rounded(R.block_refits(weekly(t), "id", "week", FEATURES, [1, 2, 3], SEEDS, 200, 28))


@query("q256_matched_null", """WITH w AS (SELECT c_mktsegment AS segment, date_trunc('week', o_orderdate)::DATE AS week, avg(o_totalprice) / 100000 AS price FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    s AS (SELECT CASE WHEN month(week) IN (12, 1, 2) THEN 'DJF' WHEN month(week) <= 5 THEN 'MAM' WHEN month(week) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CASE WHEN year(week) < 1998 THEN 'early' ELSE 'late' END AS era FROM w)
    SELECT season, era, 50 * count(*) AS n, 0::BIGINT AS strangers, TRUE AS near FROM s GROUP BY 1, 2""")
def matched_null(t: Tables) -> DataFrame:
    """Of each stratum: rows drawn, values that its own rows do not have, whether the mean is within five standard errors."""
    w = weekly(t).select("id", "season", "era", *FEATURES)
    null = R.matched_null(w, "id", ["season", "era"], FEATURES, 50, 11)
    own = w.select("season", "era", "price").distinct().withColumn("known", F.lit(True))
    real = w.groupBy("season", "era").agg(F.avg("price").alias("m"), F.stddev_pop("price").alias("s"))
    drawn = null.join(own, ["season", "era", "price"], "left").groupBy("season", "era").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("strangers"), F.avg("price").alias("mean"))
    return drawn.join(real, ["season", "era"]).select("season", "era", "n", "strangers", (F.abs(F.col("mean") - F.col("m")) <= 5 * F.col("s") / F.sqrt("n") + 1e-12).alias("near"))


@query("q257_null_envelope")
def null_envelope(t: Tables) -> DataFrame:
    return rounded(R.null_envelope(weekly(t), "id", ["season", "era"], FEATURES, [1, 2, 3, 4, 5], SEEDS, 50, family="diag"))


def daily(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 100000).alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    return o.withColumn("id", F.datediff("day", F.lit("1970-01-01")).cast("long"))


def baseline() -> Column:
    return F.year("day") <= 1999


def daily_labels(t: Tables) -> DataFrame:
    """(day, label) by the mixture of least BIC of the baseline years."""
    d = daily(t)
    _, fit = R.least_bic(d.filter(baseline()), "id", ["price", "orders"], [1, 2, 3, 4, 5], 42)
    return d.select("day", "id").join(R.labelled(d, "id", [], ["price", "orders"], fit).withColumnRenamed("key", "id"), "id").drop("id")


@query("q406_baseline_mixture")
def baseline_mixture(t: Tables) -> DataFrame:
    fits, best = R.least_bic(daily(t).filter(baseline()), "id", ["price", "orders"], [1, 2, 3, 4, 5], 42)
    return t.spark.createDataFrame([(f.k, round(f.bic("diag"), 4), f.converged, f.k == best.k) for f in fits], "k int, bic double, converged boolean, chosen boolean")


@query("q407_window_divergence")
def window_divergence(t: Tables) -> DataFrame:
    return rounded(O.window_distances(daily_labels(t), "day", "label", baseline()))


@query("q249_divergence_bootstrap")
def divergence_bootstrap(t: Tables) -> DataFrame:
    d = daily_labels(t)
    return rounded(O.divergence_bootstrap(d.filter(baseline()), d.filter(~baseline()), "day", "label", 200, 7, 42))


@query("q296_logistic")
def logistic(t: Tables) -> DataFrame:
    """Returned lines by quantity, discount, tax and price: the fit, and its mean log loss over all rows."""
    x = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_extendedprice") / 100000).alias("price"))
    fit = L.fitted(x, ["quantity", "discount", "tax", "price"], "y", 1.0)
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), fit.probability()))
    loss = x.agg(F.avg(-F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p))).alias("loss"))
    named = [F.round(F.lit(w), 6).alias(f"w_{name}") for name, w in zip(fit.features, fit.weights, strict=True)]
    return loss.select(*named, F.round(F.lit(fit.intercept), 6).alias("intercept"), F.round("loss", 8).alias("loss"))


@query("q275_cluster_stability")
def cluster_stability(t: Tables) -> DataFrame:
    return rounded(C.cluster_stability(weekly(t), "id", "segment", FEATURES, [2, 3, 4, 5, 6], 200, 0.8, 7, starts=2))
