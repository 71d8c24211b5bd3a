"""Statistics as grouped DataFrame plans: forecast scores, rank measures, corrections, agreement of labellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order import counted, running, running_least


def calibration_bins(df: DataFrame, keys: list[str], truth: str, prob: str, bins: int) -> DataFrame:
    """(keys, bin, n, mean_prob, mean_truth) for every bin, empty ones too; probability 1 falls in the last."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).cast("int")
    got = df.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(truth).alias("mean_truth"))
    spine = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(got, [*keys, "bin"], "left").fillna(0, ["n"])


def auc(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc): share of positive-negative pairs in order, ties a half.

    Rows are first counted by score, so the running count is over distinct scores.
    """
    c = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(truth)).alias("p"), F.sum(1 - F.col(truth)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = c.withColumn("w", F.col("p") * (below + F.col("q") / 2)).groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("w").alias("w"))
    return g.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def precision_recall(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """(keys, threshold, precision, recall, step): one row per distinct score; the sum of step is the area."""
    c = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(truth).alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    run = c.select(*keys, "threshold", F.sum("p").over(w).alias("_tp"), F.sum("n").over(w).alias("_k"), F.sum("p").over(Window.partitionBy(*keys)).alias("_all"))
    r = run.select(*keys, "threshold", (F.col("_tp") / F.col("_k")).alias("precision"), (F.col("_tp") / F.nullif("_all", F.lit(0))).alias("recall"))
    return r.withColumn("step", F.col("precision") * (F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df, rows with a value, with ranks from 1, ties at their average. Counted by distinct value, over range partitions."""
    c = running(counted(df, keys, value), keys, [value], "n", "upto")
    return df.join(c.select(*keys, value, (F.col("upto") - (F.col("n") - 1) / 2).alias(out)), [*keys, value])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    both = average_rank(average_rank(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "_rx"), keys, y, "_ry")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def _by_p(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """(keys, p, n, upto, total): distinct values with how many there are, how many up to them, and in all."""
    c = running(counted(df, keys, p), keys, [p], "n", "upto")
    return c.join(c.groupBy(*keys).agg(F.max("upto").alias("total")), keys)


def false_discovery(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """df, rows with a p, with q: p * n / rank, made monotone from the largest p down. Distinct values are ranked over range partitions."""
    raw = _by_p(df, keys, p).select(*keys, p, (F.col(p) * F.col("total") / (F.col("upto") - F.col("n") + 1)).alias("_q"), (-F.col(p)).alias("_down"))
    least = running_least(raw, keys, ["_down"], "_q", "q")
    return df.join(least.select(*keys, p, F.least(F.lit(1.0), "q").alias("q")), [*keys, p])


def step_down(df: DataFrame, keys: list[str], p: str, alpha: float) -> DataFrame:
    """df, rows with a p, with significant: p <= alpha / (n - i) for it and all smaller ones (i from 0). Of equal values the first
    has the strictest bound, so that one decides for all."""
    ok = _by_p(df, keys, p).select(*keys, p, (F.col(p) <= alpha / (F.col("total") - F.col("upto") + F.col("n"))).cast("int").alias("_ok"))
    all_ok = running_least(ok, keys, [p], "_ok", "_all")
    return df.join(all_ok.select(*keys, p, (F.col("_all") == 1).alias("significant")), [*keys, p])


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share; null without trials."""
    p = wins / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bottom = 1 + z * z / n
    return F.when(n > 0, (centre - spread) / bottom), F.when(n > 0, (centre + spread) / bottom)


def shares(df: DataFrame, label: str, side: str) -> DataFrame:
    """(label, p, q): the label's share among rows where side is true and where it is false, over all labels of either."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.when(F.col(side), 1)).alias("a"), F.count(F.when(~F.col(side), 1)).alias("b"))
    tot = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return c.join(F.broadcast(tot)).select("label", (F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))


def divergence(df: DataFrame, base2: bool) -> DataFrame:
    """One row js of (label, p, q): Jensen-Shannon divergence in bits, or the root of the one in nats."""
    m = (F.col("p") + F.col("q")) / 2
    log = F.log2 if base2 else F.ln
    part = lambda x: F.when(x > 0, x * log(x / m)).otherwise(0.0)
    js = F.sum(part(F.col("p")) + part(F.col("q"))) / 2
    return df.agg((js if base2 else F.sqrt(F.greatest(js, F.lit(0.0)))).alias("js"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ari from the contingency counts of two labellings."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(two(F.col("n")).alias("s"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("rb"))
    x = both.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.col("ra") * F.col("rb") / (F.col("all") * (F.col("all") - 1) / 2)
    top = (F.col("ra") + F.col("rb")) / 2
    return x.select(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))
