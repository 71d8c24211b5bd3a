"""Group-at-a-time work on sorted partitions, and connected components, as distributed plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.skew import lookup
from panelforge.llm.storage import parts, stored

#: Edges of a graph from which on some node may have more of them than a task should join at once.
HUB_EDGES = 1_000_000


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, recut so that no key's rows are split: each table holds complete groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key))
        last = col[-1]
        if held:
            first_held = held[-1].column(held[-1].schema.get_field_index(key))[-1]
            if last.as_py() == first_held.as_py():
                held.append(batch)
                continue
        lo, hi, want = 0, batch.num_rows - 1, last.as_py()
        while lo < hi:  # the first row of the last key
            mid = (lo + hi) // 2
            if col[mid].as_py() == want:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            held.append(batch.slice(0, lo))
            batch = batch.slice(lo)
        if held:
            yield pa.Table.from_batches(held)
        held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def bounded_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table | None, str]]:
    """Like whole_groups, but no table holds much more than `most` rows of one key.

    (table, "whole"): complete groups. A key with more rows comes as (table, "part") any number of times and
    then (None, "end"), with no other group in between.
    """
    held: list[pa.RecordBatch] = []
    now, rows, parted = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key)).to_numpy()
        same = int(np.argmax(col != now)) if (col != now).any() else len(col)  # rows that go on with the held key
        if same and now is not None:
            held.append(batch.slice(0, same))
            rows += same
        else:
            same = 0
        if parted or rows > most:
            if held:
                yield pa.Table.from_batches(held), "part"
            held, parted = [], True
        if same == len(col):
            continue
        if parted:
            yield None, "end"
        last = int(np.flatnonzero(col != col[-1])[-1]) + 1 if (col != col[-1]).any() else 0  # where the last key begins
        if last > same:
            held.append(batch.slice(same, last - same))
        if held:
            yield pa.Table.from_batches(held), "whole"
        held, now, parted = [batch.slice(max(last, same))], col[-1], False
        rows = held[0].num_rows
    if parted:
        yield None, "end"
    elif held:
        yield pa.Table.from_batches(held), "whole"


def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df partitioned by key and sorted by key, then order, inside each partition."""
    return df.repartition(parts(df.sparkSession), key).sortWithinPartitions(key, *order)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds: every round is joins and minima over edges, the edges
    never leave the executors, and the rounds grow with the logarithm of the graph. Hubs are joined where their edges lie. Only two numbers a
    round reach the driver, to see whether the edges still change.
    """

    def settled(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    state = settled(now)
    while state[0]:
        n = min(parts(edges.sparkSession), max(8, state[0] // 200_000))
        by_v = lambda df: df.repartition(n, "v")
        # three exchanges a round: what is grouped and joined by v below lies by v already
        both = by_v(now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m"))))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("s"), F.count(F.lit(1)).alias("n"))
        up = both.filter("m > v")
        hubs = lookup(up, least, ["v"], "n") if state[0] > HUB_EDGES else up.join(least, "v")
        large = by_v(hubs.select(F.col("m").alias("v"), F.col("s").alias("m"))).distinct()
        small = large.groupBy("v").agg(F.min("m").alias("s"))
        linked = large.join(small, "v")
        pairs = linked.filter("m <> s").select(F.col("m").alias("v"), F.col("s").alias("m")).unionByName(small.select("v", F.col("s").alias("m")))
        now = stored(by_v(pairs).distinct(), "edges")
        before, state = state, settled(now)
        if state == before:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
