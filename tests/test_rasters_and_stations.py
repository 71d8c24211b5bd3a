"""Raster files read by window, station documents, and traces held against response epochs."""

import datetime as dt
import io

import numpy as np
import pyarrow as pa
import pytest

from panelforge.sources import stations as S
from panelforge.sources import tiff as T


def opened(data):
    return pa.PythonFile(io.BytesIO(data), "r")


def test_headers_and_strips():
    z = np.arange(35.0).reshape(7, 5)
    z[2, 3] = np.nan
    data = T.encoded(z, 100.0, 900.0, 10.0, 20.0, 32645, -9999.0, 3)
    h = T.Header.of(opened(data))
    assert (h.rows, h.cols, h.strip_rows, len(h.offsets), h.scale[:2], h.tie[3:5], h.epsg, h.nodata) == (7, 5, 3, 3, (10.0, 20.0), (100.0, 900.0), 32645, -9999.0)
    got = np.vstack([h.strip(opened(data), i) for i in range(3)])
    assert np.array_equal(np.where(got == -9999.0, np.nan, got), z, equal_nan=True)
    with pytest.raises(ValueError, match="not a little-endian"):
        T.Header.of(opened(b"MM\0*" + data[4:]))


def test_windows(spark, tmp_path):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, (50, 12))
    rows = [(r, c, None if (r + c) % 7 == 0 else float(z[r, c])) for r in range(50) for c in range(12)]
    folder = f"file://{tmp_path}/tiles"
    files = T.write_tiles(spark.createDataFrame(rows, "row long, col long, v double").repartition(4), "v", folder, 12, 1000.0, 5000.0, 10.0, 10.0, 32645, -1.0, 16)
    assert files.count() == 4
    box = (1023.0, 4700.0, 1078.0, 4851.0)
    got = {(r["x"], r["y"]): r["value"] for r in T.read_window(files, *box, 32645).filter("value IS NOT NULL").collect()}
    centre = lambda r, c: (1000 + (c + 0.5) * 10, 5000 - (r + 0.5) * 10)
    assert got == {centre(r, c): v for r, c, v in rows if v is not None and box[0] <= centre(r, c)[0] <= box[2] and box[1] <= centre(r, c)[1] <= box[3]}
    # strips that the box does not reach into are never opened
    path = tmp_path / "tiles" / "tile-0.tif"
    data = bytearray(path.read_bytes())
    h = T.Header.of(opened(bytes(data)))
    data[h.offsets[0] : h.offsets[0] + 4] = b"oops"
    path.write_bytes(bytes(data))
    first = files.filter("path LIKE '%tile-0.tif'")
    assert T.read_window(first, 0.0, 0.0, 9999.0, 4839.0, 32645).count() == 0
    with pytest.raises(Exception, match="incorrect header|Error -3|invalid"):
        T.read_window(first, *box, 32645).collect()
    with pytest.raises(Exception, match="lacks EPSG:4326"):
        T.read_window(files, *box, 4326).collect()


def document(channels):
    return f'<?xml version="1.0"?><f:FDSNStationXML xmlns:f="http://www.fdsn.org/xml/station/1"><f:Source>x</f:Source><f:Network code="XX"><f:Station code="STA"><f:Latitude>1</f:Latitude>{channels}</f:Station></f:Network></f:FDSNStationXML>'.encode()


def channel(a, z, value, code="BHZ"):
    gain = "" if value is None else f"<f:Response><f:InstrumentSensitivity><f:Value>{value}</f:Value><f:Frequency>5</f:Frequency></f:InstrumentSensitivity></f:Response>"
    return f'<f:Channel code="{code}" locationCode="00" startDate="{a}"' + (f' endDate="{z}"' if z else "") + f"><f:SampleRate>50</f:SampleRate>{gain}</f:Channel>"


def test_epochs():
    got = list(S.epochs(document(channel("2020-01-01T00:00:00+02:00", "2021-01-01T00:00:00Z", 3.5) + channel("2021-01-01T00:00:00", None, None, "BHN"))))
    assert got == [
        {"network": "XX", "station": "STA", "location": "00", "channel": "BHZ", "starts": dt.datetime(2019, 12, 31, 22), "ends": dt.datetime(2021, 1, 1), "rate": 50.0, "sensitivity": 3.5},
        {"network": "XX", "station": "STA", "location": "00", "channel": "BHN", "starts": dt.datetime(2021, 1, 1), "ends": None, "rate": 50.0, "sensitivity": None},
    ]
    with pytest.raises(ValueError, match="type declaration"):
        list(S.epochs(b'<!DOCTYPE x [<!ENTITY a "b">]><FDSNStationXML/>'))
    with pytest.raises(ValueError, match="is a Other"):
        list(S.epochs(b"<Other/>"))


def test_traces_against_epochs(spark):
    day = lambda n, h=0: dt.datetime(2020, 1, n, h)
    shape = "network string, station string, location string, channel string, starts timestamp_ntz, ends timestamp_ntz"
    traces = spark.createDataFrame([("XX", "A", "", "Z", day(a), day(b)) for a, b in ((1, 2), (4, 6), (9, 11), (20, 21), (3, 3))] + [("XX", "B", "", "Z", day(1), day(2))], shape)
    responses = spark.createDataFrame([("XX", "A", "", "Z", day(1), day(5), 1.0), ("XX", "A", "", "Z", day(2), day(3), 4.0), ("XX", "A", "", "Z", day(8), None, 2.0), ("XX", "B", "", "Z", day(1), day(9), None)], shape + ", sensitivity double")
    got = {(r["station"], r["starts"].day): (r["status"], r["sensitivity"]) for r in S.covered(traces, responses).collect()}
    assert got == {("A", 1): ("COVERED", 1.0), ("A", 4): ("PARTLY", None), ("A", 9): ("COVERED", 2.0), ("A", 20): ("COVERED", 2.0), ("A", 3): ("COVERED", 4.0), ("B", 1): ("NO_RESPONSE", None)}
