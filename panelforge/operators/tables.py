"""Whole-table checks and digests: empty columns, content digests that no order changes, degrees, reconciliation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_empty_columns(df: DataFrame) -> DataFrame:
    """df without the columns that have no value at all: one pass counts them."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def row_digest(*columns: str) -> Column:
    """SHA-256 of name=value pairs in order of name; null as the empty text."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *pairs).cast("binary"), 256)


def column_digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, digest): for each column the sum of 48 bits of each value's SHA-256, so no row has to move or be sorted.

    The sum is taken whole and given as a signed 64-bit number, modulo 2 ** 64: from some 65,000 values on it may be beyond.
    """
    bits = lambda c: F.conv(F.substring(F.sha2(F.col(c).cast("string").cast("binary"), 256), 1, 12), 16, 10).cast("long")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.col(c).isNotNull(), bits(c)).alias("b")) for c in columns])).alias("x")).select("x.*")
    whole, turn = F.sum(F.col("b").cast("decimal(20,0)")).alias("whole"), F.lit(Decimal(1 << 64))
    rest = F.col("whole") % turn
    return rows.groupBy("name").agg(F.count("b").alias("n"), whole).select("name", "n", F.when(rest >= F.lit(Decimal(1 << 63)), rest - turn).otherwise(rest).cast("long").alias("digest"))


def column_audit(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(name, role, n, low, high) of numeric columns, in one pass."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(r).alias("role"), F.col(c).cast("double").alias("v")) for c, r in roles.items()])).alias("x")).select("x.*")
    return rows.groupBy("name", "role").agg(F.count("v").alias("n"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


def degrees_over(edges: DataFrame, src: str, dst: str, most: int) -> DataFrame:
    """(node, side, n) of nodes with more than `most` edges out of or into them."""
    side = lambda c, name: edges.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("node", F.lit(name).alias("side"), "n")
    return side(src, "out").unionByName(side(dst, "in"))


def reconciled(package: DataFrame, source: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """(key, differs): the columns in which a row is further than tolerance from its source; unresolved without one."""
    theirs = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    off = [F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False)), c) for c in columns]
    joined = package.join(theirs, key, "left")
    return joined.select(key, F.when(F.col("_there").isNull(), "unresolved").otherwise(F.array_join(F.array_compact(F.array(*off)), ",")).alias("differs"))
