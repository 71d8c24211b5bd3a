"""Binary records of samples in the miniSEED 2 layout: packed, and decoded by a table function."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from panelforge.operators.order import checkpointed

#: Fixed values of the format: sample encodings that are read, and the places of header, blockette and samples.
ENCODINGS = {1: ">i2", 3: ">i4", 4: ">f4", 5: ">f8"}
RECORD, SAMPLES_AT = 4096, 64
SAMPLES = (RECORD - SAMPLES_AT) // 8
FIXED = ">6sc1s5s2s3s2sHHBBBBHHhhBBBBiHH"


def packed(sequence: int, network: str, station: str, location: str, channel: str, start: dt.datetime, rate: int, samples: np.ndarray, encoding: int = 5, length: int = RECORD) -> bytes:
    """One record; its samples must fit."""
    text = lambda s, n: s.encode("ascii").ljust(n)[:n]
    tenth = start.microsecond // 100
    head = struct.pack(FIXED, b"%06d" % (sequence % 1_000_000), b"D", b" ", text(station, 5), text(location, 2), text(channel, 3), text(network, 2), start.year, start.timetuple().tm_yday, start.hour, start.minute, start.second, 0, tenth, len(samples), rate, 1, 0, 0, 0, 1, 0, SAMPLES_AT, 48)
    block = struct.pack(">HHBBBB", 1000, 0, encoding, 1, int(np.log2(length)), 0)
    data = samples.astype(ENCODINGS.get(encoding, ">f8")).tobytes()
    if SAMPLES_AT + len(data) > length:
        raise ValueError(f"{len(samples)} samples do not fit into {length} bytes")
    return (head + block).ljust(SAMPLES_AT, b"\0") + data.ljust(length - SAMPLES_AT, b"\0")


def records(data: bytes) -> Iterator[dict]:
    """Header fields of every record of a file, and its samples' bytes as they are."""
    at = 0
    while at < len(data):
        if at + 48 > len(data):
            raise ValueError(f"a record at {at} is cut off")
        f = struct.unpack_from(FIXED, data, at)
        sequence, station, location, channel, network = (f[i].decode("ascii").strip() for i in (0, 3, 4, 5, 6))
        year, day, hour, minute, second, _, tenth, count, factor, times = f[7:17]
        n_blocks, begins, block = f[20], f[22], f[23]
        encoding = order = length = None
        for _ in range(n_blocks):
            if not block or at + block + 8 > len(data):
                break
            kind, after = struct.unpack_from(">HH", data, at + block)
            if kind == 1000:
                encoding, order, power = struct.unpack_from(">BBB", data, at + block + 4)
                length = 1 << power
            block = after
        if encoding is None:
            raise ValueError(f"the record at {at} has no blockette 1000")
        if order != 1:
            raise ValueError(f"the record at {at} is not big-endian")
        if at + length > len(data) or length < 128:
            raise ValueError(f"the record at {at} is cut off")
        rate = float(factor * times) if factor > 0 and times > 0 else float(-factor / times) if factor > 0 else float(-times / factor) if times > 0 else float(1 / (factor * times)) if factor and times else 0.0
        start = dt.datetime(year, 1, 1) + dt.timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, microseconds=100 * tenth)
        yield {"sequence": int(sequence), "network": network, "station": station, "location": location, "channel": channel, "start": start, "rate": rate, "count": count, "encoding": encoding, "samples": data[at + begins : at + length]}
        at += length


def decoded(record: dict) -> np.ndarray:
    """The samples of a record; an encoding that is compressed or unknown is refused."""
    kind = ENCODINGS.get(record["encoding"])
    if kind is None:
        raise ValueError(f"encoding {record['encoding']} is not decoded")
    out = np.frombuffer(record["samples"], np.dtype(kind), count=record["count"]) if record["count"] * np.dtype(kind).itemsize <= len(record["samples"]) else None
    if out is None:
        raise ValueError(f"record {record['sequence']} has fewer samples than it says")
    return out.astype(float)


@udtf(returnType="sequence int, network string, station string, location string, channel string, start timestamp_ntz, rate double, count int, encoding int")
class RecordHeaders:
    """A row for each record of a file's bytes; null bytes have none."""

    def eval(self, data: bytes):
        for r in records(bytes(data)) if data is not None else ():
            yield tuple(r[k] for k in ("sequence", "network", "station", "location", "channel", "start", "rate", "count", "encoding"))


@udtf(returnType="sequence int, network string, station string, location string, channel string, start timestamp_ntz, rate double, nth int, value double")
class RecordSamples:
    """A row for each sample of each record of a file's bytes."""

    def eval(self, data: bytes):
        for r in records(bytes(data)) if data is not None else ():
            head = tuple(r[k] for k in ("sequence", "network", "station", "location", "channel", "start", "rate"))
            for i, v in enumerate(decoded(r).tolist()):
                yield (*head, i, v)


def write_records(series: DataFrame, folder: str, per_file: int = 4096) -> DataFrame:
    """Pack (sequence, station, channel, start, samples array<double> of SAMPLES at most) into files of per_file records; (path, n_records)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        nth = 0

        def saved() -> pa.RecordBatch:
            name = f"records-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}-{nth}.mseed"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)])], ["path", "n_records"])

        for batch in batches:
            for r in batch.to_pylist():
                held.append(packed(r["sequence"], "XX", r["station"], "", r["channel"], r["start"], 1, np.array(r["samples"], float)))
                if len(held) == per_file:
                    yield saved()
                    held, nth = [], nth + 1
        if held:
            yield saved()

    return checkpointed(series.select("sequence", "station", "channel", F.col("start").cast("timestamp_ntz").alias("start"), "samples").mapInArrow(pack, "path string, n_records long"))


def read_with(function, files: DataFrame, folder: str) -> DataFrame:
    """name and the rows that a table function makes of the bytes of each file of `folder` that files (path) lists. Files are opened by Spark."""
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    data = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.mseed").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return data.join(listed, "name", "left_semi").lateralJoin(function(F.col("content").outer())).drop("content")
