"""Event, opportunity and control tables: interval joins, linking, groups, holdouts, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order import carried_out, checkpointed


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of the same keys whose half-open intervals (unix seconds) overlap.

    Intervals are copied to the time bins of `width` seconds they touch; a pair counts in the bin where the
    later of the two starts lies, so it comes out once without a distinct.
    """
    bins = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width))))
    pairs = bins(left, *a).join(bins(right, *b), [*keys, "_bin"])
    meet = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    return pairs.filter(meet & (F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width) == F.col("_bin"))).drop("_bin")


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) by rounds of minimum labels and pointer jumping; root is the smallest node of the component.

    Each round is a join and a minimum over the edges, stored so that the plan stays short; one number a
    round reaches the driver.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = checkpointed(e)
    label = checkpointed(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = e.join(label.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy("a").agg(F.min("r").alias("r")).withColumnRenamed("a", "node")
        step = label.join(near, "node", "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"), F.col("root").alias("old"))
        jump = checkpointed(step.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"), "old"))
        changed = jump.filter("root <> old").limit(1).count()
        label = jump.drop("old")
        if not changed:
            return label


def first_overlap_dedup(events: DataFrame, keys: list[str], event: str, start: str, end: str, width: int) -> DataFrame:
    """events with duplicate_of: the earliest (start, id) event of the same keys that overlaps it, if that is earlier."""
    right = events.select(*keys, F.col(event).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    pairs = overlaps(events.select(*keys, event, start, end), right, keys, (start, end), ("_s", "_e"), width)
    before = pairs.filter(F.struct("_s", "_id") < F.struct(start, event)).groupBy(event).agg(F.min(F.struct("_s", "_id")).getField("_id").alias("duplicate_of"))
    return events.join(before, event, "left")


def pair_in_order(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str) -> DataFrame:
    """(group, left_id, right_id): the nth left id with the nth right id of each group."""
    n = lambda df, i: df.select(group, i).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(i)))
    return n(left, left_id).join(n(right, right_id), [group, "_n"]).drop("_n")


def _nearest_places(p: DataFrame, q: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(px, py, qx, qy, distance) of the distinct places of p and of q within `cell` of each other, and (px, py, distance) of the nearest.

    Places meet those of their own and the eight neighbouring grid cells: anything nearer than one cell's width lies there.
    """
    grid = lambda x, y: (F.floor(F.col(x) / cell), F.floor(F.col(y) / cell))
    a = p.select("px", "py").distinct().withColumns(dict(zip(("_gx", "_gy"), grid("px", "py"), strict=True)))
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = q.select("qx", "qy").distinct().withColumns(dict(zip(("cx", "cy"), grid("qx", "qy"), strict=True))).withColumn("o", F.explode(off))
    b = b.select("qx", "qy", (F.col("cx") + F.col("o.i")).alias("_gx"), (F.col("cy") + F.col("o.j")).alias("_gy"))
    d = a.join(b, ["_gx", "_gy"]).select("px", "py", "qx", "qy", F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2).alias("distance")).filter(F.col("distance") <= cell)
    return d, d.groupBy("px", "py").agg(F.min("distance").alias("distance"))


def nearest(points: DataFrame, targets: DataFrame, point: str, target: str, x: str, y: str, cell: float) -> DataFrame:
    """(point, target, distance): all nearest targets of each point within `cell`, ties kept. Distances are taken between places."""
    p = points.select(F.col(point).alias("point"), F.col(x).alias("px"), F.col(y).alias("py"))
    q = targets.select(F.col(target).alias("target"), F.col(x).alias("qx"), F.col(y).alias("qy"))
    d, best = _nearest_places(p, q, cell)
    return carried_out(d.join(best, ["px", "py", "distance"]), p, ["px", "py"], q, ["qx", "qy"]).select("point", "target", "distance")


def nearest_distance(points: DataFrame, targets: DataFrame, point: str, x: str, y: str, cell: float) -> DataFrame:
    """(point, distance) of the points with a target within `cell`: how far the nearest is."""
    p = points.select(F.col(point).alias("point"), F.col(x).alias("px"), F.col(y).alias("py"))
    _, best = _nearest_places(p, targets.select(F.col(x).alias("qx"), F.col(y).alias("qy")), cell)
    return p.join(best, ["px", "py"]).groupBy("point").agg(F.min("distance").alias("distance"))


def split_conflicts(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows lie in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")
