"""Resampling: seeded draws come from hashes of keys, so they are the same for every partitioning and rerun."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order import checkpointed, running


def uniform(*keys: str | Column) -> Column:
    """A number in [0, 1) from the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / float(1 << 52)


def replicated(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def label_shuffle(df: DataFrame, strata: list[str], key: str, label: str, n: int, seed: int) -> DataFrame:
    """df's (strata, key) n times, each time with the labels of a stratum dealt anew: (replicate, strata, key, label). Other
    columns of df stay with their rows and come last.

    Places and labels are numbered over range partitions, so no task holds a stratum; places are numbered once for all
    replicates. The two are merged: by its estimated size, which does not count the replicates, one would be broadcast.
    """
    keys, one = ["replicate", *strata], F.lit(1).cast("long")
    rest = [c for c in df.columns if c not in (*strata, key, label)]
    place = replicated(running(df.select(*strata, key, *rest).withColumn("_one", one), strata, [key], "_one", "_a"), n).select(*keys, "_a", key, *rest)
    wide = replicated(df.select(*strata, key, label), n).withColumn("_one", one).withColumn("_u", uniform(F.lit(seed), "replicate", key))
    labels = running(wide, keys, ["_u", key], "_one", "_a").select(*keys, "_a", label)
    return place.hint("merge").join(labels, [*keys, "_a"]).select(*keys, key, label, *rest)


def column_shuffle(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """df with each column permuted on its own: the joint structure goes, the margins stay.

    Ranks come from range partitions and their sizes, so no task holds a whole column.
    """
    out = None
    for i, c in enumerate(columns):
        spread = ranked(df.select(key, c), [uniform(F.lit(seed + i), key), F.col(key)], "_r")
        base = ranked(df.select(F.col(key).alias("_k")), [F.col("_k")], "_r")
        one = base.join(spread.select("_r", c), "_r").select(F.col("_k").alias(key), c)
        out = one if out is None else out.join(one, key)
    return out


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with row numbers from 0 in global order: local numbers in range partitions plus the sizes of those before."""
    named = df
    for i, c in enumerate(order):
        named = named.withColumn(f"_o{i}", c)
    cols = [f"_o{i}" for i in range(len(order))]
    parts = checkpointed(named.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()))  # a second reading might cut elsewhere
    local = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*cols)))
    sizes = local.groupBy("_p").agg(F.max("_n").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return local.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_n") - 1).drop("_p", "_n", "_b", *cols)


def block_permutation(series: DataFrame, key: str, day: str, value: str, first: str, last: str) -> DataFrame:
    """(key, observed, blocks, p): how often a contiguous block as long as the target window has a mean as large.

    All blocks outside the target are taken, so no draw is needed: the exact null of block starts.
    """
    length = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    w = Window.partitionBy(key).orderBy(day)
    n = series.withColumn("_i", F.row_number().over(w)).withColumn("_s", F.sum(value).over(w))
    target = n.filter(F.col(day).between(first, last)).groupBy(key).agg(F.avg(value).alias("observed"), F.count(F.lit(1)).alias("size"))
    j = n.join(target, key)
    ends = j.select(key, F.col("_i").alias("_e"), F.col("_s").alias("_se"), "observed", "size", F.col(day).alias("_d"))
    starts = n.select(F.col(key).alias("_k"), F.col("_i").alias("_j"), F.col("_s").alias("_sb"))
    means = ends.join(starts, (F.col(key) == F.col("_k")) & (F.col("_j") == F.col("_e") - F.col("size")), "left")
    block = (F.col("_se") - F.coalesce("_sb", F.lit(0.0))) / F.col("size")
    outside = (F.col("_d") < F.lit(first).cast("date")) | (F.date_sub(F.col("_d"), length - 1) > F.lit(last).cast("date"))
    ok = means.filter((F.col("_e") >= F.col("size")) & outside).withColumn("_m", block)
    return ok.groupBy(key).agg(F.first("observed").alias("observed"), F.count(F.lit(1)).alias("blocks"), F.avg((F.col("_m") >= F.col("observed")).cast("double")).alias("p"))


def sign_tests(df: DataFrame, wins: str, n: str) -> DataFrame:
    """df with p: the exact two-sided binomial p at one half of wins out of n, whatever n.

    Each pair of n and lesser side is worked out once: its tail's terms meet a table of log factorials, summed over ranges.
    """
    pairs = df.select(F.col(n).cast("long").alias("_n"), F.least(F.col(wins), F.col(n) - F.col(wins)).cast("long").alias("_k")).distinct()
    most = pairs.agg(F.max("_n")).first()[0] or 0
    logs = df.sparkSession.range(most + 1).select(F.col("id").alias("_i"), F.when(F.col("id") == 0, 0.0).otherwise(F.ln("id")).alias("_ln"))
    table = checkpointed(running(logs, [], ["_i"], "_ln", "_f").select("_i", "_f"))
    named = lambda i, f: table.select(F.col("_i").alias(i), F.col("_f").alias(f))
    terms = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "_k")).alias("_i")).withColumn("_j", F.col("_n") - F.col("_i"))
    terms = terms.join(named("_n", "_fn"), "_n").join(named("_i", "_fi"), "_i").join(named("_j", "_fj"), "_j")
    tails = terms.groupBy("_n", "_k").agg(F.least(F.lit(1.0), 2 * F.sum(F.exp(F.col("_fn") - F.col("_fi") - F.col("_fj") - F.col("_n") * math.log(2)))).alias("p"))
    at = df.withColumn("_n", F.col(n).cast("long")).withColumn("_k", F.least(F.col(wins), F.col(n) - F.col(wins)).cast("long"))
    return at.join(tails, ["_n", "_k"]).drop("_n", "_k")


def calibration_fit(df: DataFrame, truth: str, prob: str, rounds: int = 25) -> tuple[float, float]:
    """(slope, intercept) of truth on the logit of prob by Newton steps; each step gathers five sums."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(prob)))
    c = df.select(F.ln(p / (1 - p)).alias("z"), F.col(truth).cast("double").alias("y")).groupBy("z").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    a, b = 0.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("z") * a + b)))
        w = F.col("n") * q * (1 - q)
        g = F.col("y") - F.col("n") * q
        s = c.agg(F.sum(g * F.col("z")), F.sum(g), F.sum(w * F.col("z") ** 2), F.sum(w * F.col("z")), F.sum(w)).first()
        det = s[2] * s[4] - s[3] ** 2
        if not det:
            break
        da, db = (s[4] * s[0] - s[3] * s[1]) / det, (s[2] * s[1] - s[3] * s[0]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b
