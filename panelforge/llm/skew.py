"""Joining rows to per-key facts when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1024


def lookup(rows: DataFrame, facts: DataFrame, key: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined to facts (one row per key, none of it null) on key.

    The HEAVY_KEYS keys of largest weight are broadcast (so many rows at most, each of fixed width), so
    their rows are joined where they lie; only rows of lighter keys are shuffled. `rows` is read twice:
    pass a stored or cheap frame. how: inner or left.
    """
    extra = [c for c in facts.columns if c not in key]
    heavy = facts.orderBy(F.desc(weight), *key).limit(HEAVY_KEYS).withColumn("_heavy", F.lit(True))
    near = rows.join(F.broadcast(heavy), key, "left")
    hit = near.filter("_heavy").select(*rows.columns, *extra)
    far = near.filter("_heavy IS NULL").select(*rows.columns).join(facts, key, how).select(*rows.columns, *extra)
    return hit.unionByName(far)
