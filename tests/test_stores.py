"""Array stores: filters against plain cells, and which chunks are opened; binary records: round trips and refusals."""

import datetime as dt
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from panelforge.sources import arrays, seed

DAYS = [dt.date(2020, 5, 20) + dt.timedelta(days=i) for i in range(40)]
LATS = [29.0, 28.5, 28.0, 27.5, 27.0]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(d, lat, x, float(i * 100 + j * 10 + x), None if x == 3 else float(x)) for i, d in enumerate(DAYS) for j, lat in enumerate(LATS) for x in range(4) if i != 7 and not (i >= 30 and x >= 2)]
    folder = f"file://{tmp_path_factory.mktemp('arrays')}/store"
    cells = spark.createDataFrame(rows, "day date, lat double, x long, t double, u double")
    n = arrays.write_array(cells, folder, [arrays.Axis("day", DAYS, 10), arrays.Axis("lat", LATS, 2), arrays.Axis("x", [0, 1, 2, 3], 2)], ["t", "u"])
    assert n == 4 * 3 * 2 - 3  # the last ten days have no cell of the second chunk of x
    return folder, rows


FILTERS = {
    "all": ("true", lambda d, lat, x: True),
    "box": ("day >= DATE'2020-06-01' AND day < DATE'2020-06-05' AND lat BETWEEN 27.4 AND 28.2 AND x = 1", lambda d, lat, x: dt.date(2020, 6, 1) <= d < dt.date(2020, 6, 5) and 27.4 <= lat <= 28.2 and x == 1),
    "some": ("day IN (DATE'2020-05-21', DATE'2020-06-20', DATE'1999-01-01') AND x <= 2 AND lat > 28.0", lambda d, lat, x: d in (DAYS[1], dt.date(2020, 6, 20)) and x <= 2 and lat > 28),
    "rest": ("x % 2 = 1 AND t > 500 AND month(day) = 6", lambda d, lat, x: x % 2 == 1 and d.month == 6),
    "none": ("lat > 40", lambda d, lat, x: False),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters(spark, store, name):
    folder, rows = store
    text, keep = FILTERS[name]
    got = arrays.read_array(spark, folder, ["t", "u"], 2).filter(text).filter("t IS NOT NULL").drop("chunk").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if keep(*r[:3]) and (name != "rest" or r[3] > 500)), key=str)


def test_only_chunks_asked_for_are_opened(spark, store, tmp_path):
    folder, rows = store
    header = arrays.Header.of(folder, ["t"])
    reader = arrays.ArrayReader(header, 1)
    odd = StringContains(("lat",), "2")
    left = list(reader.pushFilters([GreaterThanOrEqual(("day",), DAYS[12]), LessThan(("day",), DAYS[19]), EqualTo(("lat",), 28.5), In(("x",), (0, 1)), EqualTo(("t",), 5.0), odd]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "StringContains"] and [p.places for p in reader.partitions()] == [[(1, 0, 0)]]
    copy = tmp_path / "copy"
    for p in Path(folder.removeprefix("file://")).rglob("*"):
        if p.is_file():
            to = copy / p.relative_to(folder.removeprefix("file://"))
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(b"not a chunk" if p.parent.name == "t" and p.name[0].isdigit() and p.name != "1.0.0" else p.read_bytes())
    a = arrays.read_array(spark, f"file://{copy}", ["t"])
    asked = a.filter((F.col("day") >= DAYS[12]) & (F.col("day") < DAYS[19]) & (F.col("lat") == 28.5) & (F.col("x") < 2))
    assert sorted(r["t"] for r in asked.collect()) == sorted(r[3] for r in rows if DAYS[12] <= r[0] < DAYS[19] and r[1] == 28.5 and r[2] < 2)
    assert {r["chunk"] for r in asked.select("chunk").distinct().collect()} == {"1.0.0"}
    with pytest.raises(Exception, match="incorrect header|Error -3"):
        a.filter(F.col("lat") == 28.5).collect()


def test_layout_is_that_of_the_format(store):
    folder, rows = store
    root = Path(folder.removeprefix("file://"))
    block = np.frombuffer(zlib.decompress((root / "t" / "0.1.1").read_bytes()), "<f8").reshape(10, 2, 2)
    assert block[2, 1, 0] == 2 * 100 + 3 * 10 + 2 and np.isnan(block[7]).all()
    assert '"zarr_format": 2' in (root / ".zgroup").read_text() and '"shape": [40, 5, 4]' in (root / "t" / ".zarray").read_text()


def test_refusals(spark, store, tmp_path):
    folder, _ = store
    axis = [arrays.Axis("x", [0, 1], 2)]
    with pytest.raises(Exception, match="comes twice"):
        arrays.write_array(spark.createDataFrame([(1, 2.0), (1, 3.0)], "x long, t double"), f"file://{tmp_path}/twice", axis, ["t"])
    assert arrays.write_array(spark.createDataFrame([(9, 2.0)], "x long, t double"), f"file://{tmp_path}/off", axis, ["t"]) == 0
    assert arrays.read_array(spark, f"file://{tmp_path}/off", ["t"]).filter("t IS NOT NULL").count() == 0
    assert arrays.nearest(folder, "t", {"lat": 28.3, "x": 2}) == {"lat": 28.5, "x": 2} and arrays.nearest(folder, "t", {"lat": 26.8}) == {"lat": 27.0}
    with pytest.raises(ValueError, match="outside"):
        arrays.nearest(folder, "t", {"lat": 31.0})
    with pytest.raises(ValueError, match="no variable"):
        arrays.Header.of(folder, ["gone"])
    with pytest.raises(ValueError):
        arrays.Axis("x", [], 2)


START = dt.datetime(2024, 3, 1, 12, 30, 15, 123400)


@pytest.mark.parametrize("encoding, kind", [(1, ">i2"), (3, ">i4"), (4, ">f4"), (5, ">f8")])
def test_records_of_every_encoding(encoding, kind):
    samples = np.array([0, -5, 300, 7], kind)
    data = b"".join(seed.packed(i, "XX", "STA", "00", "BHZ", START, 50, samples, encoding, 512) for i in range(3))
    found = list(seed.records(data))
    assert [(r["sequence"], r["network"], r["station"], r["location"], r["channel"], r["start"], r["rate"], r["count"], r["encoding"]) for r in found] == [(i, "XX", "STA", "00", "BHZ", START, 50.0, 4, encoding) for i in range(3)]
    assert all(seed.decoded(r).tolist() == [0, -5, 300, 7] for r in found)


def test_bad_records_fail():
    good = seed.packed(1, "XX", "STA", "", "BHZ", START, 50, np.zeros(4), 5, 512)
    with pytest.raises(ValueError, match="encoding 10 is not decoded"):
        seed.decoded(next(seed.records(seed.packed(1, "XX", "STA", "", "BHZ", START, 50, np.zeros(4), 10, 512))))
    with pytest.raises(ValueError, match="cut off"):
        list(seed.records(good[:-1]))
    with pytest.raises(ValueError, match="not big-endian"):
        list(seed.records(good[:53] + b"\0" + good[54:]))
    with pytest.raises(ValueError, match="no blockette"):
        list(seed.records(good[:48] + b"\0\1" + good[50:]))
    with pytest.raises(ValueError, match="fewer samples"):
        seed.decoded(next(seed.records(good[:30] + b"\3\0" + good[32:])))
    with pytest.raises(ValueError, match="do not fit"):
        seed.packed(1, "XX", "STA", "", "BHZ", START, 50, np.zeros(100), 5, 512)


def test_table_functions(spark, tmp_path):
    rows = [(i, f"S{i % 3}", "BHZ", START.replace(microsecond=0), [float(i * 10 + k) for k in range(i + 1)]) for i in range(7)]
    series = spark.createDataFrame(rows, "sequence int, station string, channel string, start timestamp_ntz, samples array<double>")
    folder = f"file://{tmp_path}/records"
    files = seed.write_records(series, folder, per_file=2)
    got = {(r["sequence"], r["station"], r["nth"]): r["value"] for r in seed.read_with(seed.RecordSamples, files, folder).collect()}
    assert got == {(i, s, k): v for i, s, _, _, samples in rows for k, v in enumerate(samples)}
    assert seed.read_with(seed.RecordHeaders, files, folder).filter(F.col("start") == F.lit(START.replace(microsecond=0))).count() == 7
    (tmp_path / "records" / "orphan.mseed").write_bytes(b"left by a task that failed")
    assert seed.read_with(seed.RecordHeaders, files, folder).count() == 7
