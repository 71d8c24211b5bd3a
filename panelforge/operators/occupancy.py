"""How far label shares lie apart: intervals by blocks of days, nulls by halves, and moving windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order import running
from panelforge.operators.resample import replicated, uniform


def js_distance(df: DataFrame, keys: list[str], p: str, q: str) -> DataFrame:
    """(keys, js): root of the Jensen-Shannon divergence in nats of counts p and q over the labels of each key; null if either has none."""
    total = df.groupBy(*keys).agg(F.sum(p).alias("_tp"), F.sum(q).alias("_tq"))
    both = df.join(total, keys) if keys else df.join(F.broadcast(total))
    a, b = F.col(p) / F.nullif(F.col("_tp"), F.lit(0)), F.col(q) / F.nullif(F.col("_tq"), F.lit(0))
    part = lambda x: F.when(x > 0, x * F.ln(2 * x / (a + b))).otherwise(F.when(x.isNotNull(), 0.0))
    both = both.select(*keys, (part(a) + part(b)).alias("_d"), (a + b).alias("_s"))
    return both.groupBy(*keys).agg(F.when(F.min("_s").isNotNull(), F.sqrt(F.greatest(F.sum("_d") / 2, F.lit(0.0)))).alias("js"))


def block_draws(df_or_spark: DataFrame, replicates: int, blocks: int, starts: int, seed: int) -> DataFrame:
    """(replicate, start): `blocks` starts of 1..starts for each replicate, from hashes."""
    rows = df_or_spark.sparkSession.range(replicates * blocks)
    return rows.select(F.expr(f"id div {blocks}").alias("replicate"), (F.floor(uniform(F.lit(seed), "id") * starts) + 1).alias("start"))


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with nth, from 1 by order."""
    return running(rows.withColumn("_one", F.lit(1).cast("long")), [], [order], "_one", "nth").drop("_one")


def block_counts(rows: DataFrame, length: int, n: int, label: str = "label") -> DataFrame:
    """(start, label, c): labels of the `length` rows from each start on, of rows numbered nth."""
    at = rows.select(label, F.explode(F.sequence(F.greatest(F.col("nth") - length + 1, F.lit(1)), F.least(F.col("nth"), F.lit(n - length + 1)))).alias("start"))
    return at.groupBy("start", label).agg(F.count(F.lit(1)).alias("c"))


def divergence_bootstrap(baseline: DataFrame, target: DataFrame, order: str, label: str, replicates: int, length: int, seed: int) -> DataFrame:
    """One row: observed distance of the two sides' label shares, its 95 % interval over resampled baselines, the 95th
    percentile of the distance of two random halves of the baseline, and whether the observed one exceeds that.

    A resample is as many blocks of `length` rows as fit into the baseline, drawn with replacement. Labels are counted by
    block once; a replicate adds up the counts of its blocks. Halves come from a coin a row, so their sizes are equal but for
    chance. Fewer baseline rows than a block: no interval, all null but observed and the halves'.
    """
    numbered = numbered_rows(baseline.select(order, label), order)
    n = numbered.count()
    base, goal = (side.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias(name)) for side, name in ((baseline, "p"), (target, "q")))
    labels = base.join(goal, "label", "full").fillna(0)
    observed = js_distance(labels, [], "p", "q").select(F.col("js").alias("observed"))
    every = replicated(labels, replicates)
    if n >= length:
        drawn = block_draws(baseline, replicates, max(1, n // length), n - length + 1, seed).join(block_counts(numbered, length, n, label).withColumnRenamed(label, "label"), "start")
        boot = drawn.groupBy("replicate", "label").agg(F.sum("c").alias("c"))
        told = js_distance(every.join(boot, ["replicate", "label"], "left").fillna(0, ["c"]), ["replicate"], "c", "q")
    else:
        told = every.select("replicate", F.lit(None).cast("double").alias("js")).distinct()
    coin = uniform(F.lit(seed + 1), "replicate", "nth") < 0.5
    half = replicated(numbered, replicates).groupBy("replicate", F.col(label).alias("label")).agg(F.count_if(coin).alias("a"), F.count_if(~coin).alias("b"))
    null = js_distance(half, ["replicate"], "a", "b")
    ends = told.agg(F.percentile("js", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    far = null.agg(F.percentile("js", F.lit(0.95)).alias("null_p95"))
    one = observed.join(F.broadcast(ends)).join(F.broadcast(far))
    return one.select("observed", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), "null_p95", (F.col("observed") > F.col("null_p95")).alias("exceeds"))


def window_distances(days: DataFrame, day: str, label: str, baseline: Column, length: int = 7) -> DataFrame:
    """(start, js) for every start of `length` consecutive days of one year that all have a label: the distance of their label
    shares from those of the baseline days.

    Each day goes to the windows that hold it, so windows are counted side by side whatever the length of the series.
    """
    share = days.filter(baseline & F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("q"))
    sent = days.filter(F.col(label).isNotNull()).select(F.col(day).alias("day"), F.col(label).alias("label")).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.date_sub("day", i))))
    sent = sent.filter(F.year("start") == F.year(F.date_add("start", length - 1)))
    whole = sent.groupBy("start").agg(F.count_distinct("day").alias("d"), F.count(F.lit(1)).alias("c")).filter((F.col("d") == length) & (F.col("c") == length)).select("start")
    counts = sent.groupBy("start", "label").agg(F.count(F.lit(1)).alias("p"))
    spine = whole.join(F.broadcast(share.select("label")))  # labels are a mixture's components
    spine = spine.join(counts, ["start", "label"], "left").unionByName(counts.join(whole, "start", "left_semi").join(F.broadcast(share.select("label")), "label", "left_anti").select("start", "label", "p"))
    return js_distance(spine.join(F.broadcast(share), "label", "left").fillna(0, ["p", "q"]), ["start"], "p", "q")
