"""Station metadata in the StationXML layout: channel epochs by a table function, and traces held against them."""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def _time(text: str | None) -> dt.datetime | None:
    """A time of the document in UTC; None where it is left out."""
    if not text:
        return None
    at = dt.datetime.fromisoformat(text)
    return at if at.tzinfo is None else at.astimezone(dt.UTC).replace(tzinfo=None)


def epochs(data: bytes) -> Iterator[dict]:
    """Every channel epoch of a document. Names are taken without their namespace; a document that declares entities is refused."""
    if b"<!ENTITY" in data or b"<!DOCTYPE" in data:
        raise ValueError("a document with a type declaration is not read")
    root = ET.fromstring(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    if local(root) != "FDSNStationXML":
        raise ValueError(f"the document is a {local(root)}")
    number = lambda e, path: next((float(x.text) for x in e.iter() if local(x) == path and x.text), None)
    for network in (x for x in root if local(x) == "Network"):
        for station in (x for x in network if local(x) == "Station"):
            for channel in (x for x in station if local(x) == "Channel"):
                response = next((x for x in channel if local(x) == "Response"), None)
                gain = next((x for x in response.iter() if local(x) == "InstrumentSensitivity"), None) if response is not None else None
                yield {
                    "network": network.get("code", ""), "station": station.get("code", ""), "location": channel.get("locationCode", ""), "channel": channel.get("code", ""),
                    "starts": _time(channel.get("startDate")), "ends": _time(channel.get("endDate")), "rate": number(channel, "SampleRate"),
                    "sensitivity": number(gain, "Value") if gain is not None else None,
                }


EPOCH = ("network", "station", "location", "channel", "starts", "ends", "rate", "sensitivity")


@udtf(returnType="network string, station string, location string, channel string, starts timestamp_ntz, ends timestamp_ntz, rate double, sensitivity double")
class ChannelEpochs:
    """A row for each channel epoch of a document's bytes; null bytes have none."""

    def eval(self, data: bytes):
        for e in epochs(bytes(data)) if data is not None else ():
            yield tuple(e[k] for k in EPOCH)


def covered(traces: DataFrame, responses: DataFrame) -> DataFrame:
    """traces (network, station, location, channel, starts, ends) with status: COVERED if one epoch of the channel that has a
    sensitivity holds the whole trace, PARTLY if some only overlap it, NO_RESPONSE otherwise; and the sensitivity of the
    covering epoch (of several the one that starts last). An epoch without an end goes on. Traces find their result by their
    channel and span: numbers given to rows may change when the rows are worked out again."""
    key = ["network", "station", "location", "channel"]
    span = [*key, "starts", "ends"]
    r = responses.filter("sensitivity IS NOT NULL").select(*key, F.col("starts").alias("_a"), F.coalesce("ends", F.lit("9999-12-31").cast("timestamp_ntz")).alias("_z"), "sensitivity")
    met = traces.select(*span).distinct().join(r, key).filter("_a < ends AND starts < _z OR _a <= starts AND ends <= _z")
    whole = (F.col("_a") <= F.col("starts")) & (F.col("ends") <= F.col("_z"))
    told = met.groupBy(*span).agg(F.bool_or(whole).alias("_whole"), F.max_by(F.when(whole, F.col("sensitivity")), F.when(whole, F.col("_a"))).alias("sensitivity"))
    status = F.when(F.col("_whole"), "COVERED").when(F.col("_whole").isNotNull(), "PARTLY").otherwise("NO_RESPONSE")
    return traces.join(told, span, "left").select(*traces.columns, "sensitivity", status.alias("status"))
