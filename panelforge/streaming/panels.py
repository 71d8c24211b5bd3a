"""Streaming forms of the panel operators: event-time windows, dedup and a keyed detector, over any streaming source."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(start, key, n, total) of event-time windows; rows later than the watermark are left out."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(stream: DataFrame, ts: str, key: str, width: str, step: str, late: str) -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), F.col(key))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(stream: DataFrame, ts: str, ids: list[str], late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def detector(stream: DataFrame, key: str, ts: str, value: str, mean: float, slack: float, limit: float) -> DataFrame:
    """(key, ts, score) of the rows at which a key's one-sided cumulative sum passes limit; it restarts there.

    The state of a key is one number. Rows of a batch are taken in time order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(ts)
        found = []
        for at, v in zip(rows[ts], rows[value], strict=True):
            level = max(0.0, level + float(v) - mean - slack)
            if level > limit:
                found.append((k[0], at, level))
                level = 0.0
        state.update((level,))
        yield pd.DataFrame(found, columns=[key, ts, "score"])

    kinds = dict(stream.dtypes)
    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} timestamp, score double", "level double", "append", "NoTimeout")
