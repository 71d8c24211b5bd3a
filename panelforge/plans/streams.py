"""Streaming queries run to the end of a folder, so that their output is a table like any other."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order import shared_folder
from panelforge.plans.registry import Tables, query
from panelforge.streaming import panels as P
from panelforge.streaming import states as S


def events_stream(t: Tables) -> DataFrame:
    """The events table as a stream of files. Its file or folder is found by the pattern, wherever it is stored."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, t: Tables, mode: str) -> DataFrame:
    """The result of the query once all files of its source are read, from a table in the shared folder."""
    out = f"{shared_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{number if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = t.spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in found.dtypes if k == "timestamp"})


@query("q_stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t: Tables) -> DataFrame:
    return finished(P.tumbling(events_stream(t), "ts", "event_type", "value", "1 hour", "40 days"), t, "complete").withColumn("total", F.round("total", 4))


@query("q_stream_sessions", "WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, TRUE)::INT AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT min(ts) AS \"start\", max(ts) + INTERVAL 2 HOUR AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(t: Tables) -> DataFrame:
    return finished(P.sessions(events_stream(t), "ts", "user_id", "2 hours", "40 days"), t, "complete")


@query("q_stream_detector")
def detector(t: Tables) -> DataFrame:
    return finished(P.detector(events_stream(t), "user_id", "ts", "value", 20.0, 5.0, 60.0), t, "append")


@query("q_stream_sliding", "SELECT s AS \"start\", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding(t: Tables) -> DataFrame:
    return finished(P.sliding(events_stream(t), "ts", "event_type", "6 hours", "2 hours", "40 days"), t, "complete")


@query("q_stream_flagged", "SELECT event_id, nth, nth > 1 AS repeated FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events)")
def flagged(t: Tables) -> DataFrame:
    """Every event, flagged if its user has had one of its kind on the day before it."""
    named = events_stream(t).withColumn("ident", F.concat_ws("|", "user_id", "event_type", F.to_date("ts")))
    return finished(S.flagged(named, "ident", "ts", "event_id", "40 days"), t, "append").select("event_id", "nth", "repeated")


@query("q_stream_two_sided")
def two_sided(t: Tables) -> DataFrame:
    return finished(S.two_sided(events_stream(t), "user_id", "ts", "value", 20.0, 5.0, 60.0, 7), t, "append")


LATE_SQL = "WITH b AS (SELECT *, event_id % 4 AS part FROM events), m AS (SELECT part, max(ts) AS newest FROM b GROUP BY 1), p AS (SELECT a.part, max(m.newest) AS newest FROM (SELECT DISTINCT part FROM b) a LEFT JOIN m ON m.part < a.part GROUP BY 1) SELECT event_id, coalesce(ts < newest - INTERVAL 10 DAY, FALSE) AS too_late FROM b JOIN p USING (part)"


@query("q_stream_late", LATE_SQL)
def late(t: Tables) -> DataFrame:
    """Events in four batches: those ten days or more behind what came before go to a table of their own."""
    base = f"{shared_folder(t.spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    schema = t.events.select("event_id", "ts").schema

    def newest() -> object:
        return written("on-time").agg(F.max("ts")).first()[0]

    def written(name: str) -> DataFrame:
        return t.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/{name}")

    def keep(name: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/{name}/batch-{number}")

    for name in ("in", "on-time", "late"):
        t.spark.createDataFrame([], schema).write.parquet(f"{base}/{name}/none")
    sink = S.divided("ts", "10 days", newest, keep("on-time"), keep("late"))
    for part in range(4):
        t.events.filter(F.col("event_id") % 4 == part).select("event_id", "ts").write.parquet(f"{base}/in/part-{part}")
        stream = t.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return written("on-time").select("event_id", F.lit(False).alias("too_late")).unionByName(written("late").select("event_id", F.lit(True).alias("too_late")))
