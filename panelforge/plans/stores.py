"""Queries over array stores and binary records that are written from the tables first."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order import shared_folder
from panelforge.plans.registry import Tables, query
from panelforge.sources import arrays, seed, stations, tiff

VARIABLES = ["quantity", "items"]


def new_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shipments(t: Tables) -> str:
    """An array store of shipments: quantity and items by day, line and discount in percent."""
    cells = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").cast("long").alias("line"), F.round(F.col("l_discount") * 100).cast("long").alias("percent"))
    cells = cells.agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("items"))
    first, last, lines, percent = t.lineitem.agg(F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate")), F.max("l_linenumber"), F.max(F.round(F.col("l_discount") * 100))).first()
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    axes = [arrays.Axis("day", days, 92), arrays.Axis("line", list(range(1, int(lines) + 1)), 4), arrays.Axis("percent", list(range(int(percent) + 1)), 4)]
    folder = new_folder(t, "shipments")
    arrays.write_array(cells, folder, axes, VARIABLES)
    return folder


CELLS_SQL = "c AS (SELECT CAST(l_shipdate AS DATE) AS day, l_linenumber::BIGINT AS line, round(l_discount * 100)::BIGINT AS percent, sum(l_quantity) AS quantity, count(*)::DOUBLE AS items FROM lineitem GROUP BY 1, 2, 3)"


@query("q10_array_scan", f"WITH {CELLS_SQL} SELECT day, line, percent, round(quantity, 4) AS quantity, items FROM c WHERE line <= 3 AND percent BETWEEN 4 AND 7 AND day BETWEEN DATE '1997-06-01' AND DATE '1997-08-31'")
def array_scan(t: Tables) -> DataFrame:
    """A box and a season of the store: of its chunks only those that reach into them are opened."""
    a = arrays.read_array(t.spark, shipments(t), VARIABLES)
    box = a.filter((F.col("line") <= 3) & F.col("percent").between(4, 7) & F.col("day").between(dt.date(1997, 6, 1), dt.date(1997, 8, 31)))
    return box.filter("items IS NOT NULL").select("day", "line", "percent", F.round("quantity", 4).alias("quantity"), "items")


@query("q1_nearest_cell_series", f"WITH {CELLS_SQL} SELECT day, 3::BIGINT AS line, 5::BIGINT AS percent, round(quantity, 4) AS quantity, items FROM c WHERE line = 3 AND percent = 5")
def nearest_series(t: Tables) -> DataFrame:
    """The series of the cell nearest to a place between cells."""
    folder = shipments(t)
    at = arrays.nearest(folder, "quantity", {"line": 3.4, "percent": 4.6})
    a = arrays.read_array(t.spark, folder, VARIABLES)
    for name, value in at.items():
        a = a.filter(F.col(name) == value)
    return a.filter("items IS NOT NULL").select("day", "line", "percent", F.round("quantity", 4).alias("quantity"), "items")


def measured(t: Tables) -> DataFrame:
    """Events as samples: station, day, place in the day."""
    e = t.events.filter("value IS NOT NULL").select(F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("station"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("station", "day").orderBy("ts", "event_id")) - 1)


def recorded(t: Tables) -> tuple[DataFrame, str]:
    """Binary records of the samples, and the folder that they lie in."""
    n = F.floor(F.col("nth") / seed.SAMPLES).cast("int")
    rows = measured(t).groupBy("station", "day", (n + 1).alias("sequence")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("samples"))
    folder = new_folder(t, "records")
    return seed.write_records(rows.select("sequence", "station", F.lit("EVT").alias("channel"), F.col("day").alias("start"), "samples"), folder), folder


SAMPLES_SQL = f"s AS (SELECT 'S' || (user_id % 20) AS station, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY user_id % 20, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS nth FROM events WHERE value IS NOT NULL), r AS (SELECT *, (nth // {seed.SAMPLES} + 1)::INT AS sequence FROM s)"


@query("q27_record_headers", f"WITH {SAMPLES_SQL} SELECT station, 'EVT' AS channel, 'XX' AS network, CAST(day AS TIMESTAMP) AS start, sequence, count(*)::INT AS n, 5 AS encoding, 1.0::DOUBLE AS rate FROM r GROUP BY ALL")
def record_headers(t: Tables) -> DataFrame:
    files, folder = recorded(t)
    h = seed.read_with(seed.RecordHeaders, files, folder)
    return h.select("station", "channel", "network", "start", "sequence", F.col("count").alias("n"), "encoding", "rate")


@query("q28_decoded_samples", f"WITH {SAMPLES_SQL} SELECT station, day, sequence, (nth % {seed.SAMPLES})::INT AS nth, value FROM r")
def decoded_samples(t: Tables) -> DataFrame:
    files, folder = recorded(t)
    return seed.read_with(seed.RecordSamples, files, folder).select("station", F.to_date("start").alias("day"), "sequence", "nth", "value")


#: Parts as a raster of 40 columns, 90 m cells, one in eleven without a value.
_X0, _Y0, _STEP = 250000.0, 3100000.0, 90.0


@query("q19_raster_window", f"""WITH g AS (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, CASE WHEN p_partkey % 11 <> 5 THEN p_retailprice END AS value FROM part), c AS (SELECT ({_X0} + (col + 0.5) * {_STEP})::DOUBLE AS x, ({_Y0} - (row + 0.5) * {_STEP})::DOUBLE AS y, value FROM g)
    SELECT x, y, value FROM c WHERE x BETWEEN 250500 AND 252900 AND y BETWEEN 3097300 AND 3099100 AND value IS NOT NULL""")
def raster_window(t: Tables) -> DataFrame:
    """The cells of a box, read from raster files of which only the strips that reach into it are opened."""
    k = F.col("p_partkey")
    grid = t.part.select(F.expr("p_partkey div 40").alias("row"), (k % 40).alias("col"), F.when(k % 11 != 5, F.col("p_retailprice")).alias("v"))
    files = tiff.write_tiles(grid, "v", new_folder(t, "tiles"), 40, _X0, _Y0, _STEP, _STEP, 32645, -9999.0, 16)
    return tiff.read_window(files, 250500.0, 3097300.0, 252900.0, 3099100.0, 32645).filter("value IS NOT NULL").select("x", "y", "value")


def described(t: Tables) -> DataFrame:
    """(station, data): a document for each station, with two epochs of its channel, the second without an end; some lack a response."""
    s = measured(t).select("station").distinct()
    n = F.substring("station", 2, 4).cast("int")
    channel = lambda a, z, gain: F.concat(F.lit(f'<Channel code="EVT" locationCode="" startDate="{a}"' + (f' endDate="{z}"' if z else "") + "><SampleRate>1</SampleRate>"), F.when(n % 5 == gain, "").otherwise(F.concat(F.lit("<Response><InstrumentSensitivity><Value>"), ((n + 1) * (1 if z else 2)).cast("string"), F.lit("</Value></InstrumentSensitivity></Response>"))), F.lit("</Channel>"))
    body = F.concat(F.lit('<FDSNStationXML xmlns="http://www.fdsn.org/xml/station/1"><Network code="XX"><Station code="'), "station", F.lit('">'), channel("2024-01-01T00:00:00Z", "2024-01-12T12:00:00Z", 3), channel("2024-01-13T00:00:00", None, 4), F.lit("</Station></Network></FDSNStationXML>"))
    return s.select("station", body.cast("binary").alias("data"))


_EPOCHS_SQL = "st AS (SELECT DISTINCT user_id % 20 AS n FROM events WHERE value IS NOT NULL), ep AS (SELECT 'S' || n AS station, TIMESTAMP '2024-01-01' AS starts, TIMESTAMP '2024-01-12 12:00:00' AS ends, CASE WHEN n % 5 <> 3 THEN (n + 1)::DOUBLE END AS sensitivity FROM st UNION ALL SELECT 'S' || n, TIMESTAMP '2024-01-13', NULL, CASE WHEN n % 5 <> 4 THEN 2.0 * (n + 1) END FROM st)"


@query("q29_channel_epochs", f"WITH {_EPOCHS_SQL} SELECT station, 'XX' AS network, 'EVT' AS channel, starts, ends, 1.0::DOUBLE AS rate, sensitivity FROM ep")
def channel_epochs(t: Tables) -> DataFrame:
    e = described(t).drop("station").lateralJoin(stations.ChannelEpochs(F.col("data").outer()))
    return e.select("station", "network", "channel", "starts", "ends", "rate", "sensitivity")


@query("q30_verified_bundle", f"""WITH {_EPOCHS_SQL}, tr AS (SELECT 'S' || (user_id % 20) AS station, user_id % 20 AS n, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS starts, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
    j AS (SELECT tr.station, tr.n, tr.starts, c, bool_or(ep.starts <= tr.starts AND tr.starts + INTERVAL 1 DAY <= coalesce(ep.ends, TIMESTAMP '9999-12-31')) AS whole, max(sensitivity) FILTER (ep.starts <= tr.starts AND tr.starts + INTERVAL 1 DAY <= coalesce(ep.ends, TIMESTAMP '9999-12-31')) AS sensitivity
        FROM tr LEFT JOIN ep ON ep.station = tr.station AND sensitivity IS NOT NULL AND ep.starts < tr.starts + INTERVAL 1 DAY AND tr.starts < coalesce(ep.ends, TIMESTAMP '9999-12-31') GROUP BY ALL)
    SELECT station, starts, c AS samples, CASE WHEN n % 7 = 2 THEN 'DIGEST_DIFFERS' WHEN whole THEN 'COVERED' WHEN whole IS NOT NULL THEN 'PARTLY' ELSE 'NO_RESPONSE' END AS status, CASE WHEN n % 7 <> 2 THEN sensitivity END AS sensitivity FROM j""")
def verified_bundle(t: Tables) -> DataFrame:
    """Daily traces against the response epochs of documents whose bytes have the declared digest; others count for nothing."""
    docs = described(t)
    n = F.substring("station", 2, 4).cast("int")
    declared = docs.select("station", F.when(n % 7 == 2, "other").otherwise(F.sha2("data", 256)).alias("declared"))
    judged = docs.join(declared, "station").withColumn("same", F.sha2("data", 256) == F.col("declared"))
    responses = judged.filter("same").select("data").lateralJoin(stations.ChannelEpochs(F.col("data").outer())).drop("data")
    traces = measured(t).groupBy("station", F.col("day").cast("timestamp_ntz").alias("starts")).agg(F.count(F.lit(1)).alias("samples"))
    traces = traces.select("station", "starts", "samples", (F.col("starts") + F.expr("INTERVAL 1 DAY")).alias("ends"), F.lit("XX").alias("network"), F.lit("").alias("location"), F.lit("EVT").alias("channel"))
    held = stations.covered(traces, responses).join(judged.select("station", "same"), "station")
    return held.select("station", "starts", "samples", F.when(~F.col("same"), "DIGEST_DIFFERS").otherwise(F.col("status")).alias("status"), "sensitivity")
