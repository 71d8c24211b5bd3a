"""Chunked arrays in the layout of Zarr version 2: written from tables of cells, read back as one, chunks that no filter asks for unopened."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Coordinates of one axis at most: axes are held whole wherever chunks are planned, read or written.
MOST_COORDINATES = 5_000_000
#: Rows of one Arrow batch.
BATCH = 65_536
EPOCH = dt.date(1970, 1, 1)
DAYS = "days since 1970-01-01"


@dataclass(frozen=True)
class Axis:
    """A dimension: its coordinates in order, ascending or descending, and how many of them a chunk spans. Dates are whole days."""

    name: str
    values: Sequence
    chunk: int

    def __post_init__(self) -> None:
        if not len(self.values) or len(self.values) > MOST_COORDINATES or self.chunk < 1:
            raise ValueError(f"axis {self.name} has {len(self.values)} coordinates in chunks of {self.chunk}")

    @property
    def dated(self) -> bool:
        return isinstance(self.values[0], dt.date)

    def numbers(self) -> np.ndarray:
        return np.array([(v - EPOCH).days for v in self.values], np.int64) if self.dated else np.asarray(self.values)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, name: str, data: bytes) -> None:
    store, root = _store(folder)
    path = f"{root}/{name}"
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def _read(folder: str, name: str) -> bytes | None:
    store, root = _store(folder)
    try:
        with store.open_input_file(f"{root}/{name}") as file:
            return file.read()
    except FileNotFoundError:
        return None


def _described(shape: list[int], chunks: list[int], kind: np.dtype) -> bytes:
    fill = "NaN" if kind.kind == "f" else 0
    return json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None}).encode()


def write_array(cells: DataFrame, folder: str, axes: list[Axis], variables: list[str]) -> int:
    """Write cells (one column an axis, one a variable, a row a cell) as an array store; returns the chunks written.

    Each chunk is one task's group, of as many cells at most as it spans; chunks without cells are not written and read as
    null. Cells off the axes are left out, a cell that comes twice is an error. Values are stored as doubles.
    """
    spark, shape, span = cells.sparkSession, [len(a.values) for a in axes], [a.chunk for a in axes]
    placed = cells
    for i, a in enumerate(axes):
        kind = dict(cells.dtypes)[a.name]
        table = spark.createDataFrame(pa.table({a.name: pa.array(list(a.values)), f"_i{i}": pa.array(range(len(a.values)), pa.int64())}))
        table = table.withColumn(a.name, F.col(a.name).cast(kind))
        placed = placed.join(F.broadcast(table) if len(a.values) <= 1_000_000 else table, a.name)
    chunk = [F.floor(F.col(f"_i{i}") / c).alias(f"_c{i}") for i, c in enumerate(span)]
    inner = [(F.col(f"_i{i}") % c).alias(f"_o{i}") for i, c in enumerate(span)]
    ready = placed.select(*chunk, *inner, *[F.col(v).cast("double").alias(v) for v in variables])
    keys, n = [f"_c{i}" for i in range(len(axes))], len(axes)

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.ravel_multi_index([pdf[f"_o{i}"].to_numpy() for i in range(n)], span)
        if len(np.unique(at)) < len(at):
            raise ValueError(f"a cell of chunk {key} comes twice")
        for v in variables:
            block = np.full(int(np.prod(span)), np.nan)
            block[at] = pdf[v].to_numpy(float)
            _write(folder, f"{v}/{'.'.join(str(int(k)) for k in key)}", zlib.compress(block.astype("<f8").tobytes(), 1))
        return pd.DataFrame({"cells": [len(at)]})

    done = ready.groupBy(*keys).applyInPandas(save, "cells long").count()
    _write(folder, ".zgroup", b'{"zarr_format": 2}')
    for a in axes:
        numbers = a.numbers()
        numbers = numbers.astype("<i8" if numbers.dtype.kind in "iu" else "<f8")
        _write(folder, f"{a.name}/0", zlib.compress(numbers.tobytes(), 1))
        _write(folder, f"{a.name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": [a.name]} | ({"units": DAYS} if a.dated else {})).encode())
        _write(folder, f"{a.name}/.zarray", _described([len(numbers)], [len(numbers)], numbers.dtype))
    for v in variables:
        _write(folder, f"{v}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": [a.name for a in axes]}).encode())
        _write(folder, f"{v}/.zarray", _described(shape, span, np.dtype("<f8")))
    return done


@dataclass
class Header:
    """What a variable's metadata say, with its axes."""

    folder: str
    variables: list[str]
    dims: list[str]
    shape: list[int]
    chunks: list[int]
    axes: dict[str, np.ndarray]
    dated: set[str] = field(default_factory=set)

    @staticmethod
    def of(folder: str, variables: list[str]) -> Header:
        found = []
        for v in variables:
            meta, attrs = (_read(folder, f"{v}/{name}") for name in (".zarray", ".zattrs"))
            if meta is None or attrs is None:
                raise ValueError(f"{folder} has no variable {v}")
            meta, dims = json.loads(meta), json.loads(attrs)["_ARRAY_DIMENSIONS"]
            if meta["zarr_format"] != 2 or meta["order"] != "C" or meta["filters"] or (meta["compressor"] or {}).get("id") not in (None, "zlib", "gzip") or np.dtype(meta["dtype"]).kind not in "fiu":
                raise ValueError(f"{v} of {folder} is stored in a way that is not read here")
            found.append((dims, meta["shape"], meta["chunks"]))
        if any(x != found[0] for x in found):
            raise ValueError(f"variables {variables} of {folder} do not share a grid")
        out = Header(folder, variables, *found[0], axes={})
        for d in out.dims:
            meta, attrs = json.loads(_read(folder, f"{d}/.zarray")), json.loads(_read(folder, f"{d}/.zattrs"))
            out.axes[d] = np.concatenate([_decoded(_read(folder, f"{d}/{i}"), meta, [min(meta["chunks"][0], meta["shape"][0])]) for i in range(-(-meta["shape"][0] // meta["chunks"][0]))])[: meta["shape"][0]]
            if attrs.get("units") == DAYS:
                out.dated.add(d)
        return out

    def schema(self) -> T.StructType:
        kind = lambda d: T.DateType() if d in self.dated else T.LongType() if self.axes[d].dtype.kind in "iu" else T.DoubleType()
        return T.StructType([T.StructField(d, kind(d)) for d in self.dims] + [T.StructField(v, T.DoubleType()) for v in self.variables] + [T.StructField("chunk", T.StringType())])


def _decoded(raw: bytes, meta: dict, shape: list[int]) -> np.ndarray:
    data = zlib.decompressobj(47).decompress(raw) if meta["compressor"] else raw
    return np.frombuffer(data, np.dtype(meta["dtype"])).reshape(shape)


@dataclass
class Chunks(InputPartition):
    """Chunks of one task, by their place in the grid of chunks."""

    places: list[tuple[int, ...]]

    def __init__(self, places: list[tuple[int, ...]]) -> None:
        super().__init__(None)
        self.places = places


class ArrayReader(DataSourceReader):
    """Comparisons of an axis with values choose coordinates; chunks with none chosen on some axis are never planned."""

    def __init__(self, header: Header, per_task: int) -> None:
        self.header, self.per_task = header, per_task
        self.chosen = {d: np.ones(n, bool) for d, n in zip(header.dims, header.shape, strict=True)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.chosen:
                yield f
                continue
            axis, there = self.header.axes[name], None
            number = lambda v, name=name: (v - EPOCH).days if name in self.header.dated else v
            match f:
                case IsNotNull():
                    there = np.ones(len(axis), bool)
                case EqualTo(value=v):
                    there = axis == number(v)
                case GreaterThan(value=v):
                    there = axis > number(v)
                case GreaterThanOrEqual(value=v):
                    there = axis >= number(v)
                case LessThan(value=v):
                    there = axis < number(v)
                case LessThanOrEqual(value=v):
                    there = axis <= number(v)
                case In(value=vs):
                    there = np.isin(axis, [number(v) for v in vs if v is not None])
            if there is None:
                yield f
            else:
                self.chosen[name] &= there

    def partitions(self) -> list[InputPartition]:
        h = self.header
        some = [np.unique(np.flatnonzero(self.chosen[d]) // c).tolist() for d, c in zip(h.dims, h.chunks, strict=True)]
        places = list(itertools.product(*some))
        return [Chunks(places[i : i + self.per_task]) for i in range(0, len(places), self.per_task)]

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is asked for
            return
        h = self.header
        metas = {v: json.loads(_read(h.folder, f"{v}/.zarray")) for v in h.variables}
        names = [f.name for f in h.schema().fields]
        for place in partition.places:
            chunk = ".".join(map(str, place))
            inner = [np.flatnonzero(self.chosen[d][p * c : (p + 1) * c]) for d, p, c in zip(h.dims, place, h.chunks, strict=True)]
            at = [p * c + i for p, c, i in zip(place, h.chunks, inner, strict=True)]
            grid = np.meshgrid(*at, indexing="ij")
            columns = []
            for d, g in zip(h.dims, grid, strict=True):
                column = pa.array(h.axes[d][g.ravel()])
                columns.append(column.cast(pa.int32()).cast(pa.date32()) if d in h.dated else column)
            for v in h.variables:
                raw = _read(h.folder, f"{v}/{chunk}")
                if raw is None:
                    columns.append(pa.nulls(grid[0].size, pa.float64()))
                    continue
                values = _decoded(raw, metas[v], h.chunks)[np.ix_(*inner)].ravel().astype(float)
                columns.append(pa.array(values, mask=np.isnan(values)))
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([chunk] * grid[0].size)], names)
            for start in range(0, batch.num_rows, BATCH):
                yield batch.slice(start, BATCH)


class ArraySource(DataSource):
    """spark.read.format("array"): options path, variables (comma-separated), chunks_per_task. One row a cell, with the chunk it came from."""

    @classmethod
    def name(cls) -> str:
        return "array"

    def _header(self) -> Header:
        return Header.of(self.options["path"], [v.strip() for v in self.options["variables"].split(",")])

    def schema(self) -> T.StructType:
        return self._header().schema()

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(self._header(), int(self.options.get("chunks_per_task", "1")))


def read_array(spark: SparkSession, folder: str, variables: list[str], chunks_per_task: int = 1) -> DataFrame:
    """The cells of an array store: axes, variables, chunk. Filters on axes reach the chunks, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)
    return spark.read.format("array").option("variables", ",".join(variables)).option("chunks_per_task", chunks_per_task).load(folder)


def nearest(folder: str, variable: str, wanted: dict[str, float]) -> dict[str, float]:
    """The coordinate nearest to each wanted one, the first of two as near; an error if it lies more than half a step off the axis."""
    header, out = Header.of(folder, [variable]), {}
    for d, v in wanted.items():
        axis = header.axes[d].astype(float)
        far = np.abs(axis - v)
        step = np.abs(np.diff(axis)).min() if len(axis) > 1 else np.inf
        if far.min() > step / 2 and not axis.min() <= v <= axis.max():
            raise ValueError(f"{d} = {v} lies outside the array")
        out[d] = header.axes[d][int(far.argmin())].item()
    return out
