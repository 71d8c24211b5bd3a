"""Building panels from raw series: member merges, gap rules, daily frames, calendars and requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.catalogue import ERA_BOUNDARY_YEAR


def box_means(cells: DataFrame, at: list[str], values: list[str]) -> DataFrame:
    """One row for each `at`: means over the cells of a box."""
    return cells.groupBy(*at).agg(*[F.avg(v).alias(v) for v in values])


def coalesced(members: DataFrame, at: list[str], member: str, values: list[str]) -> DataFrame:
    """One row for each `at` from members that hold different variables or times; `sources` lists what more than one gave.

    A value that two members hold is an anomaly, not something to choose from: the largest count of sources of any value
    comes along, so a caller can refuse.
    """
    counts = [F.count(v) for v in values]
    return members.groupBy(*at).agg(*[F.max(v).alias(v) for v in values], F.greatest(*counts, F.lit(0)).alias("sources"), F.count_distinct(member).alias("members"))


def joined_hourly(series: DataFrame, other: DataFrame, at: list[str], months: list[int], time: str) -> DataFrame:
    """Rows of the season that both series have."""
    return series.filter(F.month(time).isin(*months)).join(other, at)


def daily_means(rows: DataFrame, unit: str, time: str, values: list[str]) -> DataFrame:
    """(unit, day, means, n): no row for a day without windows."""
    return rows.groupBy(unit, F.to_date(time).alias("day")).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def panel(frame: DataFrame, unit: str, day: str, elevation: Column) -> DataFrame:
    """frame with the carriers of a panel: group, season, era and elevation."""
    era = F.when(F.year(day) < ERA_BOUNDARY_YEAR, f"pre_{ERA_BOUNDARY_YEAR}").otherwise(f"post_{ERA_BOUNDARY_YEAR}")
    return frame.withColumns({"basin_group": F.col(unit), "season": F.lit("JJA"), "era": era, "elevation_m": elevation})


def mean_without_nulls(cells: DataFrame, at: list[str], value: str) -> DataFrame:
    """Spatial means that are null where any cell is: no cell is skipped."""
    return cells.groupBy(*at).agg(F.when(F.count(F.when(F.col(value).isNull(), 1)) == 0, F.avg(value)).alias(value))


def merged_selections(rows: DataFrame, at: list[str], order: str, value: str) -> DataFrame:
    """One value for each `at` from overlapping selections: the first by order, with how many different ones there were."""
    return rows.groupBy(*at).agg(F.min_by(value, order).alias(value), F.count_distinct(value).alias("different"))


def components_merged(rows: DataFrame, at: list[str], channel: str, channels: list[str], value: str) -> DataFrame:
    """One row for each `at` with a column for each channel, and whether all are there."""
    wide = rows.groupBy(*at).agg(*[F.max(F.when(F.col(channel) == c, F.col(value))).alias(c) for c in channels])
    return wide.withColumn("complete", sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0)) == len(channels))


def computable(series: DataFrame, unit: str, day: str, lags: list[int]) -> DataFrame:
    """(unit, n, n_ref): days, and days of which every one of the lags is there, by joins on shifted days."""
    have = series.select(unit, day).distinct()
    need = have.select(unit, F.col(day).alias("_at"), F.explode(F.array(*map(F.lit, lags))).alias("_lag")).select(unit, "_at", F.date_sub("_at", F.col("_lag")).alias(day))
    met = need.join(have, [unit, day]).groupBy(unit, "_at").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(lags))
    return have.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).join(met.groupBy(unit).agg(F.count(F.lit(1)).alias("n_ref")), unit, "left").na.fill(0, ["n_ref"])


def request_days(months: DataFrame, first: str, cutoff: str) -> DataFrame:
    """months (first: their first day) with the days to ask for: none after the cutoff."""
    last = F.least(F.last_day(first), F.lit(cutoff).cast("date"))
    return months.withColumn("day", F.explode(F.when(F.col(first) <= F.lit(cutoff).cast("date"), F.sequence(F.col(first), last)).otherwise(F.array().cast("array<date>"))))


def request_groups(rows: DataFrame, site: str, day: str) -> DataFrame:
    """(days, sites, n_days): sites of a month that want the same days are one request."""
    wanted = rows.groupBy(site, F.trunc(day, "month").alias("month")).agg(F.array_sort(F.collect_set(F.dayofmonth(day))).alias("_d"))
    return wanted.groupBy("month", F.concat_ws(",", F.transform("_d", lambda d: d.cast("string"))).alias("days"), F.size("_d").alias("n_days")).agg(F.count(F.lit(1)).alias("sites"))


def month_outcomes(series: DataFrame, unit: str, day: str, value: str, offset: int) -> DataFrame:
    """(unit, month, n, mean): the value `offset` days after every day of a month, as if an event had been on it."""
    after = series.select(unit, F.date_sub(day, offset).alias(day), F.col(value).alias("_after"))
    return series.select(unit, day).join(after, [unit, day]).groupBy(unit, F.month(day).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("_after").alias("mean"))


def event_score(series: DataFrame, unit: str, day: str, value: str, window: int) -> DataFrame:
    """series with z: the rolling sum over `window` rows (null before there are as many) against its mean and spread in the same calendar month."""
    w = Window.partitionBy(unit).orderBy(day).rowsBetween(1 - window, 0)
    rolled = series.withColumn("rolled", F.when(F.count(value).over(w) == window, F.sum(value).over(w)))
    usual = rolled.groupBy(unit, F.month(day).alias("_m")).agg(F.avg("rolled").alias("_a"), F.stddev_samp("rolled").alias("_s"))
    return rolled.withColumn("_m", F.month(day)).join(usual, [unit, "_m"]).withColumn("z", F.when(F.col("_s") > 0, (F.col("rolled") - F.col("_a")) / F.col("_s"))).drop("_m", "_a", "_s")


def dense_grid(values: DataFrame, rows: int, cols: int, row: str, col: str, value: str) -> DataFrame:
    """Every cell of a rows x cols grid with its value, null where there is none or it is not finite."""
    spark = values.sparkSession
    grid = spark.range(rows).select(F.col("id").cast("int").alias(row)).withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    ok = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    return grid.join(values.select(row, col, ok.alias(value)), [row, col], "left")


@dataclass(frozen=True)
class Grid:
    """A raster's coordinate system, shape and affine transform."""

    crs: str
    rows: int
    cols: int
    transform: tuple[float, ...]


def aligned(cells: DataFrame, meta: DataFrame, target: Grid) -> DataFrame:
    """Cells (raster, ..., value) with problems, the list of what of a raster (raster, crs, rows, cols, transform, nodata) is not
    exactly the target's: crs, shape, transform, or nodata if it is not declared.

    A raster with problems has one row without a cell; of the others the no-data value becomes null. Meta is one row a raster.
    """
    off = lambda test, name: F.when(F.coalesce(test, F.lit(True)), name)
    told = F.array(off(F.col("crs") != target.crs, "crs"), off((F.col("rows") != target.rows) | (F.col("cols") != target.cols), "shape"), off(F.col("transform") != F.array(*map(F.lit, target.transform)), "transform"), F.when(F.col("nodata").isNull(), "nodata"))
    judged = meta.select("raster", "nodata", F.filter(told, lambda x: x.isNotNull()).alias("problems"))
    good = cells.join(judged.filter("size(problems) = 0"), "raster").withColumn("value", F.nullif("value", F.col("nodata"))).drop("nodata")
    return good.unionByName(judged.filter("size(problems) > 0").select("raster", "problems"), allowMissingColumns=True)
