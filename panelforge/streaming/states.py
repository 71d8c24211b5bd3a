"""Stateful streams: two-sided detection with rest, repeats flagged and kept, rows that come too late set aside."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_sided(stream: DataFrame, key: str, ts: str, value: str, mean: float, slack: float, limit: float, rest: int) -> DataFrame:
    """(key, ts, side, score) of the rows at which a key's upward or downward sum of departures from mean passes limit.

    Both sums restart there, and a further one is told `rest` rows on at the earliest: a passing sooner neither counts nor
    restarts. The state of a key is four numbers. Rows of a batch are taken in time order, batches as they come.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        up, down, seen, last = state.get if state.exists else (0.0, 0.0, 0, -1)
        rows = pd.concat(list(batches)).sort_values([ts, value], kind="stable")
        found = []
        for at, v in zip(rows[ts], rows[value], strict=True):
            up, down = max(0.0, up + float(v) - mean - slack), max(0.0, down - float(v) + mean - slack)
            if max(up, down) > limit and (last < 0 or seen - last >= rest):
                found.append((k[0], at, "up" if up >= down else "down", max(up, down)))
                up, down, last = 0.0, 0.0, seen
            seen += 1
        state.update((up, down, seen, last))
        yield pd.DataFrame(found, columns=[key, ts, "side", "score"])

    kinds = dict(stream.dtypes)
    rows = stream.filter(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(key, ts, value)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} timestamp, side string, score double", "up double, down double, seen long, last long", "append", "NoTimeout")


def flagged(stream: DataFrame, ident: str, ts: str, order: str, late: str, buckets: int = 4096) -> DataFrame:
    """(ident, ts, order, nth, repeated): every row, with how often its ident has come up to it. Nothing is dropped.

    Rows of a batch are taken by ts, then order. An ident is forgotten once the watermark, `late` behind the newest row, has
    passed its last row by as much again; rows behind the watermark are not seen any more. Idents are dealt by hash to
    buckets, whose states list theirs: a call costs more than the few rows of an ident, so it takes a bucket's rows.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        known, seen, until = state.get if state.exists else ([], [], [])
        held, now = pd.DataFrame({"seen": seen, "until": until}, index=pd.Index(known, dtype=object), dtype="int64"), state.getCurrentWatermarkMs()
        told, touched = None, held.index[:0]
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
            by = rows.groupby("_key", sort=False)
            nth = by.cumcount() + 1 + rows["_key"].map(held["seen"]).fillna(0).astype("int64")
            told = pd.DataFrame({ident: rows[ident], ts: rows[ts], order: rows[order], "nth": nth, "repeated": nth > 1})
            last = (by[ts].max() - pd.Timestamp(0, tz=rows[ts].dt.tz)) // pd.Timedelta("1ms")
            new = pd.DataFrame({"seen": by.size(), "until": (last + delay).clip(lower=now + 1)})
            touched = new.index
            both = held.reindex(touched, fill_value=0)
            new["seen"] += both["seen"]
            new["until"] = new["until"].where(new["until"] > both["until"], both["until"])
            held = pd.concat([held[~held.index.isin(touched)], new])
        held = held[(held["until"] >= now) | held.index.isin(touched)]
        if len(held):
            state.update((held.index.tolist(), held["seen"].tolist(), held["until"].tolist()))
            state.setTimeoutTimestamp(max(int(held["until"].min()), now + 1))
        else:
            state.remove()
        if told is not None:
            yield told

    kinds = dict(stream.dtypes)
    delay = int(pd.Timedelta(late).total_seconds() * 1000)
    key = F.to_json(F.struct(ident))  # a text for every ident, null too
    rows = stream.withWatermark(ts, late).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), key.alias("_key"), ident, ts, order)
    return rows.groupBy("_bucket").applyInPandasWithState(step, f"{ident} {kinds[ident]}, {ts} timestamp, {order} {kinds[order]}, nth long, repeated boolean", "idents array<string>, seen array<long>, until array<long>", "append", "EventTimeTimeout")


def divided(ts: str, late: str, newest: Callable[[], Any], on_time: Callable[[DataFrame, int], None], too_late: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that hands rows more than `late` behind the newest row of earlier batches to too_late, all others
    to on_time; rows without a time are too late. newest: the newest time written on time so far, None at first."""

    def sink(batch: DataFrame, number: int) -> None:
        last = newest()
        bound = None if last is None else pd.Timestamp(last) - pd.Timedelta(late)
        behind = F.col(ts).isNull() if bound is None else F.col(ts).isNull() | (F.col(ts) < F.lit(bound.to_pydatetime()))
        on_time(batch.filter(~behind), number)
        too_late(batch.filter(behind), number)

    return sink
