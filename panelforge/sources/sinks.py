"""Sinks: written once, in one order, with a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """A table that is never overwritten: the write fails if path exists."""
    df.write.mode("errorifexists").parquet(path)


def ordered_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV with columns by name and rows by keys; arrays are joined by "|". Range partitioning keeps the files in order."""
    flat = [F.array_join(c, "|").alias(c) if k.startswith("array") else F.col(c) for c, k in sorted(df.dtypes)]
    df.orderBy(*keys).select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def ordered_json(df: DataFrame, path: str, keys: list[str]) -> None:
    df.orderBy(*keys).select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that depends on the rows alone, not on their order or partitioning.

    Each row is hashed in a canonical form; the 256-bit hashes are summed in four parts of 64 bits, so the
    digest is a plain aggregate: partial sums, then one row.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]).cast("binary"), 256).alias("digest"))
