"""Joins of boxes, points and polygons: equi-joins on grid cells, exact tests as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order import carried_out


def box_overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(a, b, shared, iou, of_a, of_b, pattern) of boxes (id, x0, y0, x1, y1) that share area; pattern: one or many on either side.

    Distinct boxes are copied to the grid cells that they touch; a pair comes out in the cell where the shared box begins. Pairs
    are counted for each id by how often a box comes, then carried out to ids.
    """
    side = ["x0", "y0", "x1", "y1"]
    other = [f"_{c}" for c in side]
    a = left.select(F.col("id").alias("a"), *side)
    b = right.select(F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in side])
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    binned = lambda df, x0, y0, x1, y1, n: df.groupBy(x0, y0, x1, y1).agg(F.count(F.lit(1)).alias(n)).withColumn("gx", F.explode(cells(x0, x1))).withColumn("gy", F.explode(cells(y0, y1)))
    pairs = binned(a, *side, "like_a").join(binned(b, *other, "like_b"), ["gx", "gy"])
    x, y = F.greatest("x0", "_x0"), F.greatest("y0", "_y0")
    wide, high = F.least("x1", "_x1") - x, F.least("y1", "_y1") - y
    met = pairs.filter((wide > 0) & (high > 0) & (F.floor(x / cell) == F.col("gx")) & (F.floor(y / cell) == F.col("gy")))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    met = met.select(*side, *other, "like_a", "like_b", (wide * high).alias("shared"), area("").alias("_a"), area("_").alias("_b"))
    count = lambda rows, name, on, like: rows.join(met.groupBy(*on).agg(F.sum(like).alias("n")), on).groupBy(name).agg(F.sum("n").alias(f"n_{name}"))
    a, b = a.join(count(a, "a", side, "like_b"), "a"), b.join(count(b, "b", other, "like_a"), "b")
    many = lambda c: F.when(F.col(c) > 1, "MANY").otherwise("ONE")
    links = met.select(*side, *other, "shared", (F.col("shared") / (F.col("_a") + F.col("_b") - F.col("shared"))).alias("iou"), (F.col("shared") / F.col("_a")).alias("of_a"), (F.col("shared") / F.col("_b")).alias("of_b"))
    return carried_out(links, a, side, b, other).select("a", "b", "shared", "iou", "of_a", "of_b", F.concat(many("n_b"), F.lit("_TO_"), many("n_a")).alias("pattern"))


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How many edges of a ring (array of points with x and y, the first not repeated) a ray to the right of (x, y) crosses."""
    n = F.size(ring)
    edge = lambda i: (ring[i], ring[F.pmod(i + 1, n)])

    def crosses(i: Column) -> Column:
        p, q = edge(i)
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda a, c: a + c)


def inside(x: Column, y: Column, ring: Column) -> Column:
    return crossings(x, y, ring) % 2 == 1


def ring_area(ring: Column) -> Column:
    """The area of a ring, by the shoelace sum."""
    n = F.size(ring)
    part = lambda i: ring[i]["x"] * ring[F.pmod(i + 1, n)]["y"] - ring[F.pmod(i + 1, n)]["x"] * ring[i]["y"]
    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0.0), lambda a, c: a + c)) / 2
