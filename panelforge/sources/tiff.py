"""Grids as GeoTIFF files, one a tile of rows, and windows read from them strip by strip."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order import checkpointed

#: Fixed values of the format: tags, and bytes of each kind of value.
WIDTH, LENGTH, BITS, COMPRESSION, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 339
SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
PROJECTED = 3072
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
PACK = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}


def encoded(grid: np.ndarray, x0: float, y0: float, dx: float, dy: float, epsg: int, nodata: float, strip_rows: int = 16) -> bytes:
    """A float64 grid as a file; (x0, y0) is its upper left corner, rows go down by dy."""
    rows, cols = grid.shape
    strips = [zlib.compress(np.where(np.isnan(grid[r : r + strip_rows]), nodata, grid[r : r + strip_rows]).astype("<f8").tobytes()) for r in range(0, rows, strip_rows)]
    places = 8 + np.concatenate([[0], np.cumsum([len(s) for s in strips])])
    said = repr(float(nodata)).encode() + b"\0"
    tags = [
        (WIDTH, 4, [cols]), (LENGTH, 4, [rows]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (OFFSETS, 4, places[:-1].tolist()), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [strip_rows]),
        (COUNTS, 4, [len(s) for s in strips]), (FORMAT, 3, [3]), (SCALE, 12, [dx, dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (GEO_KEYS, 3, [1, 1, 0, 1, PROJECTED, 0, 1, epsg]), (NODATA, 2, list(said)),
    ]
    at = int(places[-1]) + int(places[-1]) % 2
    extra, entries, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{PACK[kind]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), beyond + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    body = b"II*\0" + struct.pack("<I", at) + b"".join(strips)
    return body.ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


@dataclass
class Header:
    """What a file says of its grid, and where its strips are."""

    rows: int
    cols: int
    strip_rows: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    scale: tuple[float, ...]
    tie: tuple[float, ...]
    epsg: int | None
    nodata: float | None
    packed: bool

    @staticmethod
    def of(file: pa.NativeFile) -> Header:
        """Only the directory is read. What is not a single float64 band in strips, plain or deflated, is refused."""
        file.seek(0)
        head = file.read(8)
        if head[:4] != b"II*\0":
            raise ValueError("not a little-endian TIFF file")
        file.seek(struct.unpack("<I", head[4:])[0])
        (n,) = struct.unpack("<H", file.read(2))
        raw, tags = file.read(12 * n), {}
        for i in range(n):
            tag, kind, count = struct.unpack_from("<HHI", raw, 12 * i)
            size = SIZES.get(kind, 1) * count
            if size <= 4:
                data = raw[12 * i + 8 : 12 * i + 8 + size]
            else:
                file.seek(struct.unpack_from("<I", raw, 12 * i + 8)[0])
                data = file.read(size)
            tags[tag] = data if kind == 2 else struct.unpack(f"<{count}{PACK[kind]}", data) if kind in PACK else ()
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        if one(BITS) != 64 or one(FORMAT, 1) != 3 or one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (1, 8) or OFFSETS not in tags:
            raise ValueError("the file is stored in a way that is not read here")
        keys = tags.get(GEO_KEYS, ())
        epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] == PROJECTED), None)
        nodata = float(tags[NODATA].rstrip(b"\0 ")) if NODATA in tags else None
        return Header(one(LENGTH), one(WIDTH), one(STRIP_ROWS, one(LENGTH)), tags[OFFSETS], tags[COUNTS], tags.get(SCALE, ()), tags.get(TIEPOINT, ()), epsg, nodata, one(COMPRESSION, 1) == 8)

    def strip(self, file: pa.NativeFile, i: int) -> np.ndarray:
        file.seek(self.offsets[i])
        raw = file.read(self.counts[i])
        return np.frombuffer(zlib.decompress(raw) if self.packed else raw, "<f8").reshape(-1, self.cols)


def write_tiles(grid: DataFrame, value: str, folder: str, cols: int, x0: float, y0: float, dx: float, dy: float, epsg: int, nodata: float, tile_rows: int = 64) -> DataFrame:
    """Write cells (row, col, value) as one file for each tile of tile_rows rows: (path). (x0, y0) is the corner of row 0, column 0."""

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((tile_rows, cols), np.nan)
        z[pdf["row"].to_numpy() - key[0] * tile_rows, pdf["col"].to_numpy()] = pdf["v"].to_numpy(float)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/tile-{key[0]}.tif", compression=None) as out:
            out.write(encoded(z, x0, y0 - key[0] * tile_rows * dy, dx, dy, epsg, nodata))
        return pd.DataFrame({"path": [f"{folder}/tile-{key[0]}.tif"]})

    cells = grid.filter(F.col("col").between(0, cols - 1)).select("row", "col", F.col(value).cast("double").alias("v"), F.floor(F.col("row") / tile_rows).alias("tile"))
    return checkpointed(cells.groupBy("tile").applyInPandas(save, "path string"))


CELLS = "path string, strip int, x double, y double, value double"


def read_window(files: DataFrame, x0: float, y0: float, x1: float, y1: float, epsg: int) -> DataFrame:
    """(path, strip, x, y, value) of the cells of the files (path) whose centres lie in the box, the no-data value as null.

    A file in another coordinate system, or without one, without a scale or without a declared no-data value, is an error, as
    its cells would be misplaced or made up. Of the others only the directory and the strips that reach into the box are read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    h = Header.of(file)
                    if h.epsg != epsg or not h.scale or not h.tie or h.nodata is None:
                        raise ValueError(f"{path} lacks EPSG:{epsg}, a scale or a no-data value")
                    xs = h.tie[3] + (np.arange(h.cols) - h.tie[0] + 0.5) * h.scale[0]
                    ys = h.tie[4] - (np.arange(h.rows) - h.tie[1] + 0.5) * h.scale[1]
                    c, r = np.flatnonzero((xs >= x0) & (xs <= x1)), np.flatnonzero((ys >= y0) & (ys <= y1))
                    for i in np.unique(r // h.strip_rows).tolist() if len(c) else ():
                        own = r[r // h.strip_rows == i]
                        z = h.strip(file, i)[np.ix_(own - i * h.strip_rows, c)].ravel()
                        yy, xx = np.meshgrid(ys[own], xs[c], indexing="ij")
                        missing = np.isnan(z) | (z == h.nodata)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(z)), pa.array(np.full(len(z), i, np.int32)), pa.array(xx.ravel()), pa.array(yy.ravel()), pa.array(z, mask=missing)], ["path", "strip", "x", "y", "value"])

    return files.select("path").mapInArrow(read, CELLS)
