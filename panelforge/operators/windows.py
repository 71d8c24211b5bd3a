"""Window operators on dated panels: runs, gap-safe rolling, calendar baselines, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_key(ts: str, accumulated: bool = False) -> Column:
    """The day of a reading. Accumulated variables are read at the end of their hour: midnight closes the day before."""
    t = F.col(ts)
    return F.to_date(F.when(F.hour(t) == 0, t - F.expr("INTERVAL 1 HOUR")).otherwise(t) if accumulated else t)


def with_runs(df: DataFrame, keys: list[str], day: str, run: str = "run_id") -> DataFrame:
    """df with a number for each stretch of consecutive days of a key."""
    w = Window.partitionBy(*keys).orderBy(day)
    gap = F.coalesce((F.datediff(day, F.lag(day).over(w)) != 1).cast("int"), F.lit(1))
    return df.withColumn(run, F.sum(gap).over(w).cast("long"))


def rolling(df: DataFrame, keys: list[str], day: str, value: str, length: int, how: str = "sum", out: str = "rolled", gaps: bool = False) -> DataFrame:
    """df with the sum or mean of the last `length` rows; null unless all are there, non-null and on consecutive days.

    gaps: partial windows count and may span gaps (the rule of at least one value).
    """
    fn = {"sum": F.sum, "mean": F.avg}[how](value)
    if gaps:
        return df.withColumn(out, fn.over(Window.partitionBy(*keys).orderBy(day).rowsBetween(1 - length, 0)))
    runs = with_runs(df, keys, day, "_run")
    w = Window.partitionBy(*keys, "_run").orderBy(day).rowsBetween(1 - length, 0)
    return runs.withColumn(out, F.when(F.count(value).over(w) == length, fn.over(w))).drop("_run")


def spells(df: DataFrame, keys: list[str], day: str, condition: Column, least: int = 1) -> DataFrame:
    """(keys, start, end, length) of every maximal stretch of consecutive days that meet condition, of `least` days or more."""
    w = Window.partitionBy(*keys).orderBy(day)
    hit = df.filter(condition).withColumn("_n", F.row_number().over(w))
    island = hit.withColumn("_g", F.date_sub(F.col(day), F.col("_n")))
    return island.groupBy(*keys, "_g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("_g")


def doy_pairs(target: DataFrame, baseline: DataFrame, keys: list[str], day: str, value: str, band: int, circular: bool = False) -> DataFrame:
    """Each target row with every baseline value of the same key whose day of year is within band.

    The baseline is first cut to (value, count) per key and day of year, so the expansion over the band and
    the join are as large as the calendar, not as the history: every later statistic weighs by the count.
    """
    own = baseline.filter(F.col(value).isNotNull()).groupBy(*keys, F.dayofyear(day).alias("_d"), F.col(value).alias("base")).agg(F.count(F.lit(1)).alias("n"))
    spread = own.withColumn("doy", F.explode(F.sequence(F.col("_d") - band, F.col("_d") + band))).drop("_d")
    if circular:
        spread = spread.withColumn("doy", F.pmod(F.col("doy") - 1, F.lit(366)) + 1)
    spread = spread.groupBy(*keys, "doy", "base").agg(F.sum("n").alias("n"))
    return target.withColumn("doy", F.dayofyear(day)).join(spread, [*keys, "doy"])


def doy_moments(target: DataFrame, baseline: DataFrame, keys: list[str], day: str, value: str, band: int) -> DataFrame:
    """target rows with n, mean and sample spread of the baseline values in their calendar band.

    Moments are summed per day of year first (one row for each key and calendar day), then over the band.
    """
    x = F.col(value)
    by_day = baseline.filter(x.isNotNull()).groupBy(*keys, F.dayofyear(day).alias("_d")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    spread = by_day.withColumn("doy", F.explode(F.sequence(F.col("_d") - band, F.col("_d") + band)))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    raw = spread.groupBy(*keys, "doy").agg(F.sum("n").alias("base_n"), mean.alias("base_mean"), F.collect_list(F.struct("n", "m", "v")).alias("parts"))
    square = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["v"] + (p["m"] - F.col("base_mean")) * (p["m"] - F.col("base_mean"))))
    stats = raw.select(*keys, "doy", "base_n", "base_mean", F.when(F.col("base_n") > 1, F.sqrt(square / (F.col("base_n") - 1))).alias("base_std"))
    return target.withColumn("doy", F.dayofyear(day)).join(stats, [*keys, "doy"], "left")


def zscore(value: Column, mean: Column, std: Column, n: Column, least: int, flat: float | None) -> Column:
    """(value - mean) / std with `least` values or more; `flat` (0 or null) where the spread is zero."""
    return F.when(n >= least, F.when(std == 0, F.lit(flat).cast("double")).otherwise((value - mean) / std))


def midrank(value: str, keys: list[str]) -> Column:
    """Share below plus half the share equal, in percent, among the rows of a key."""
    w = Window.partitionBy(*keys)
    below = F.rank().over(w.orderBy(value)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return 100.0 * (below + 0.5 * ties) / F.count(F.lit(1)).over(w)


def bounded_band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_from: str, right_to: str, width: int) -> DataFrame:
    """left rows with right rows of the same keys whose [right_from, right_to] (unix seconds) holds left_at.

    Both sides meet in time bins of `width` seconds: an interval is copied to the bins it touches, a point
    lies in one, so this is an equi-join whatever the data.
    """
    binned = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(right_from) / width), F.floor(F.col(right_to) / width))))
    points = left.withColumn("_bin", F.floor(F.col(left_at) / width))
    return points.join(binned, [*keys, "_bin"]).filter((F.col(left_at) >= F.col(right_from)) & (F.col(left_at) <= F.col(right_to))).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """left with the last right row of the same keys at or before left_at (null if none).

    One sort of both sides together by key and time, and a running last non-null: no pairs are formed.
    Right rows at equal times resolve to the largest values.
    """
    packed = F.struct(F.col(right_at).alias("at"), *[F.col(v) for v in values])
    newest = right.groupBy(*keys, F.col(right_at).alias("_t")).agg(F.max(packed).alias("_r")).withColumn("_side", F.lit(0))
    both = left.withColumn("_t", F.col(left_at)).withColumn("_side", F.lit(1)).unionByName(newest, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*left.columns, F.col("_last.at").alias(f"matched_{right_at}"), *[F.col(f"_last.{v}").alias(f"matched_{v}") for v in values])
