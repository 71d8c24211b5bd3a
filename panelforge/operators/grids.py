"""Grid operators: neighbourhood derivatives, percentile layers, priority ranking and its stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import geometric_mean


def neighbours(grid: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """(row, col, value, near): each cell with the map of its neighbours, keyed "dr,dc".

    Every cell is sent to the cells it neighbours, then gathered by cell: (2 * reach + 1)**2 rows for each.
    """
    steps = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)]
    off = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps])
    sent = grid.select("row", "col", F.col(value).alias("v"), F.explode(off).alias("o"))
    at = sent.select((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), F.concat_ws(",", "o.r", "o.c").alias("k"), "v")
    got = at.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("near"))
    return got.filter(F.map_contains_key("near", "0,0")).withColumn("value", F.col("near")["0,0"])


def slope_aspect(grid: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """(row, col, slope, aspect) in degrees from the 3x3 weighted differences; null at edges, aspect -1 where flat.

    Rows grow southward. aspect is the bearing downhill, clockwise from north.
    """
    n = neighbours(grid, value)
    v = lambda r, c: F.col("near")[f"{r},{c}"]
    east = ((v(-1, 1) + 2 * v(0, 1) + v(1, 1)) - (v(-1, -1) + 2 * v(0, -1) + v(1, -1))) / (8 * dx)
    south = ((v(1, -1) + 2 * v(1, 0) + v(1, 1)) - (v(-1, -1) + 2 * v(-1, 0) + v(-1, 1))) / (8 * dy)
    whole = F.size("near") == 9
    g = n.select("row", "col", F.when(whole, east).alias("e"), F.when(whole, south).alias("s"))
    steep = F.degrees(F.atan(F.sqrt(F.col("e") ** 2 + F.col("s") ** 2)))
    bearing = F.pmod(F.degrees(F.atan2(-F.col("e"), F.col("s"))) + 360.0, F.lit(360.0))
    return g.select("row", "col", steep.alias("slope"), F.when((F.col("e") == 0) & (F.col("s") == 0), -1.0).otherwise(bearing).alias("aspect"))


def curvature(grid: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """(row, col, curvature): the Laplacian by second differences; null at edges."""
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    v = F.col(value)
    side = lambda w, axis, k: F.when(F.abs(F.lag(axis, k).over(w) - F.col(axis)) == 1, F.lag(value, k).over(w))
    second = (side(by_row, "col", 1) - 2 * v + side(by_row, "col", -1)) / (dx * dx) + (side(by_col, "row", 1) - 2 * v + side(by_col, "row", -1)) / (dy * dy)
    return grid.select("row", "col", second.alias("curvature"))


def spread(grid: DataFrame, value: str, reach: int) -> DataFrame:
    """(row, col, relief, roughness): range and population spread of the (2 * reach + 1)**2 cells; null at edges."""
    n = neighbours(grid, value, reach)
    vals = F.map_values("near")
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size("near")
    n = n.withColumn("m", mean)
    rough = F.sqrt(F.aggregate(F.map_values("near"), F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("near"))
    whole = F.size("near") == (2 * reach + 1) ** 2
    return n.select("row", "col", F.when(whole, F.array_max(vals) - F.array_min(vals)).alias("relief"), F.when(whole, rough).alias("roughness"))


def priority(terrain: list[Column], exposure: list[Column], observability: Column) -> tuple[Column, Column, Column]:
    """Terrain index, exposure index and their product with observability, null unless all three are there."""
    a, b = geometric_mean(*terrain), geometric_mean(*exposure)
    return a, b, a * b * observability


#: Higher first, missing and non-finite last, ties by id.
def candidate_order(id_col: str, *scores: str) -> list[Column]:
    finite = [F.when(~F.isnan(s) & (F.abs(F.col(s)) < float("inf")), F.col(s)) for s in scores]
    return [*[F.desc_nulls_last(f) for f in finite], F.asc(id_col)]


def top_without_each(rows: DataFrame, id_col: str, terrain: list[str], exposure: list[str], observability: str, k: int = 5, digits: int = 10) -> DataFrame:
    """(left_out, place, id): the first k cells by priority, rounded to `digits`, with all layers ("") and with each layer left out.

    All variants are scored in one pass over the cells; each keeps k rows a partition before they meet.
    """
    variants = []
    for out in ["", *terrain, *exposure]:
        a, b = [F.col(c) for c in terrain if c != out], [F.col(c) for c in exposure if c != out]
        score = (geometric_mean(*a) if a else F.lit(None).cast("double")) * (geometric_mean(*b) if b else F.lit(None).cast("double")) * F.col(observability)
        variants.append(F.struct(F.lit(out).alias("left_out"), F.round(score, digits).alias("score")))
    wide = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*variants)).alias("x")).select("id", "x.*").filter("score IS NOT NULL")
    near = wide.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("left_out", "_p").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= k)
    place = F.row_number().over(Window.partitionBy("left_out").orderBy(F.desc("score"), "id"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select("left_out", "place", "id")
