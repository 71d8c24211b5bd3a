"""Ranks and quantiles of whole tables: counted by distinct value, then run over range partitions, so no task holds a group."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share; one of our own only where it is unset and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="panelforge-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) of the rows that have a value."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def running(df: DataFrame, keys: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """df with the sum of weight over the rows of its keys up to and including this one, by order.

    Rows are cut into ranges; each range runs on its own, and the ranges' sums (one row for each range and key in it) give
    what comes before. The ranges are kept, since a second reading might cut elsewhere. Rows and sums are merged, since rows
    that were copied are estimated at their size before that, and might be broadcast.
    """
    cut = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    own = cut.withColumn("_own", F.sum(weight).over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = cut.groupBy("_range", *keys).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return own.hint("merge").join(base, ["_range", *keys]).withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def running_least(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the least value over the rows of its keys up to and including this one, by order; ranges as in running."""
    cut = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    own = cut.withColumn("_own", F.min(value).over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("_range", *keys).agg(F.min(value).alias("_least")).select("_range", *keys, F.min("_least").over(before).alias("_before"))
    return own.hint("merge").join(base, ["_range", *keys]).withColumn(out, F.least("_before", "_own")).drop("_range", "_own", "_before")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys, q): exact quantiles, linear between neighbours, as an array in order of `at`."""
    c = running(counted(df, keys, value), keys, [value], "n", "upto")
    total = c.groupBy(*keys).agg(F.max("upto").alias("_n"))
    rows = c.join(total, keys) if keys else c.join(F.broadcast(total))
    place = lambda q: q * (F.col("_n") - 1)
    held = lambda r: F.max(F.when((F.col("upto") - F.col("n") <= r) & (F.col("upto") > r), F.col(value)))
    picked = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *[held(side(place(q))).alias(f"_{name}{i}") for i, q in enumerate(at) for name, side in (("lo", F.floor), ("hi", F.ceil))])
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place(q) - F.floor(place(q))) for i, q in enumerate(at)]
    return picked.select(*keys, F.array(*between).alias("q"))


def midranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the share below plus half the share equal, in percent, among the rows of its keys; null without a value.

    Distinct values are summed over ranges, so no task holds a group.
    """
    c = running(counted(df, keys, value), keys, [value], "n", "_upto")
    share = 100.0 * (F.col("_upto") - F.col("n") / 2) / F.col("_all")
    c = c.join(c.groupBy(*keys).agg(F.sum("n").alias("_all")), keys).select(*keys, value, share.alias(out))
    return df.join(c, [*keys, value], "left")


def carried_out(links: DataFrame, left: DataFrame, left_on: list[str], right: DataFrame, right_on: list[str], how: str = "inner", spread: int = 8) -> DataFrame:
    """Every row of left with each row of right that links (left_on, right_on, ...) bring together; how "left" keeps the others.

    Where many rows have the same place or shape, a relation between those is worked out once, in links, and only carried out
    to rows here. The rows come out of as many tasks as shuffles have, each place of right copied to `spread` of them: neither
    the small size of what goes in nor a frequent place puts most of what comes out into one task, and nothing is broadcast.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one text for the place: rows dealt by doubles would be dealt again, to few tasks, since a join makes its doubles alike first
    text = lambda c, kind: ((F.col(c) + 0.0) if kind in ("double", "float") else F.col(c)).cast("string")
    place = F.concat(*[x for c, kind in right.select(*right_on).dtypes for x in (text(c, kind), F.lit("|"))]).alias("_place")
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(spread))).join(links, left_on, how).select("*", place).repartition(parts, "_place", "_salt")
    copied = right.select("*", place).drop(*right_on).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))).repartition(parts, "_place", "_salt")
    return dealt.hint("merge").join(copied, ["_place", "_salt"], how).drop("_place", "_salt")
