"""Terrain layers over tiles that share a border of cells, and grids warped onto other grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a tile's side, and the aspect of flat cells (fixed value).
TILE, FLAT = 256, -9999.0
LAYERS = "row long, col long, slope double, aspect double, relief double, roughness double"


def tiled(grid: DataFrame, value: str, reach: int, tile: int) -> DataFrame:
    """(tr, tc, row, col, v): every cell in its own tile and in those whose border of `reach` cells it lies in."""
    over = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    return grid.select("row", "col", F.col(value).cast("double").alias("v")).select("*", over("row").alias("tr")).select("*", over("col").alias("tc"))


def _slid(z: np.ndarray, reach: int, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """op over the square of cells within reach, one axis after the other; cells that lack count for nothing."""
    for axis in (0, 1):
        out = z
        for step in range(1, reach + 1):
            for there in (step, -step):
                moved = np.full_like(z, np.nan)
                to, at = [slice(None)] * 2, [slice(None)] * 2
                to[axis], at[axis] = (slice(there, None), slice(None, -there)) if there > 0 else (slice(None, there), slice(-there, None))
                moved[tuple(to)] = z[tuple(at)]
                out = op(out, moved)
        z = out
    return z


def layers_of(z: np.ndarray, fill: float, dx: float, dy: float, reach: int) -> dict[str, np.ndarray]:
    """slope, aspect, relief, roughness of a tile with its border; nan where a cell lacks.

    Gradients are the weighted 3x3 differences; where one of their cells lacks, the central difference of the grid with
    missing cells at `fill`, one-sided at the outermost cells given.
    """
    with np.errstate(invalid="ignore"):
        p = np.pad(z, 1, constant_values=np.nan)
        v = lambda r, c: p[1 + r : p.shape[0] - 1 + r, 1 + c : p.shape[1] - 1 + c]
        east = ((v(-1, 1) + 2 * v(0, 1) + v(1, 1)) - (v(-1, -1) + 2 * v(0, -1) + v(1, -1))) / (8 * dx)
        north = ((v(-1, -1) + 2 * v(-1, 0) + v(-1, 1)) - (v(1, -1) + 2 * v(1, 0) + v(1, 1))) / (8 * dy)
        full = np.where(np.isnan(z), fill, z)
        plain = lambda a, axis, step: np.gradient(a, step, axis=axis) if a.shape[axis] > 1 else np.zeros_like(a)
        east = np.where(np.isnan(east), plain(full, 1, dx), east)
        north = np.where(np.isnan(north), -plain(full, 0, dy), north)
        slope = np.degrees(np.arctan(np.hypot(east, north)))
        bearing = np.degrees(np.arctan2(-east, -north)) % 360.0
        aspect = np.where((east == 0) & (north == 0), FLAT, bearing)
        relief = _slid(z, reach, np.fmax) - _slid(z, reach, np.fmin)
        near = np.stack([v(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)])
        n = (~np.isnan(near)).sum(0)
        mean = np.where(n > 0, np.nansum(near, axis=0) / np.maximum(n, 1), np.nan)
        rough = np.sqrt(np.nansum((near - mean) ** 2, axis=0) / np.maximum(n, 1))
    return {k: np.where(np.isnan(z), np.nan, a) for k, a in (("slope", slope), ("aspect", aspect), ("relief", relief), ("roughness", rough))}


def terrain_layers(grid: DataFrame, value: str, dx: float, dy: float, window: int = 9, tile: int = TILE) -> DataFrame:
    """(row, col, slope, aspect, relief, roughness) of every cell that has a value, those at edges too.

    Rows grow southward. slope in degrees; aspect the bearing downhill, FLAT where level; relief the range of the window of
    cells around; roughness the spread of the 3x3. The grid reaches from its least to its largest row and column; a cell that
    is absent or null lacks. Where the 3x3 differences miss a cell, differences of the grid filled with its mean stand in,
    one-sided at its edges. A task holds one tile with its border. One row (extent and mean) reaches every tile.
    """
    reach = max(window // 2, 1)
    extent = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.avg(F.col(value).cast("double")).alias("fill"))
    cells = tiled(grid, value, reach, tile).join(F.broadcast(extent))

    def layers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, r1, c0, c1, fill = pdf.iloc[0][["r0", "r1", "c0", "c1", "fill"]]
        top, left = max(key[0] * tile - reach, int(r0)), max(key[1] * tile - reach, int(c0))
        bottom, right = min((key[0] + 1) * tile + reach, int(r1) + 1), min((key[1] + 1) * tile + reach, int(c1) + 1)
        z = np.full((bottom - top, right - left), np.nan)
        z[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = pdf["v"].to_numpy(float)
        out = layers_of(z, fill, dx, dy, reach)
        r, c = np.nonzero(~np.isnan(z))
        own = ((r + top) // tile == key[0]) & ((c + left) // tile == key[1])
        r, c = r[own], c[own]
        return pd.DataFrame({"row": r + top, "col": c + left} | {k: a[r, c] for k, a in out.items()})

    return cells.groupBy("tr", "tc").applyInPandas(layers, LAYERS)


def long_form(layers: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """(key, component, value): one row for each layer of a cell."""
    return layers.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("value")) for n in names])).alias("x")).select(*key, "x.*")


def warped(source: DataFrame, value: str, targets: DataFrame, at: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """(row, col, value) of every target cell (row, col), bilinear between the four source cells around it.

    at: where the centre of a target cell lies in the source, as fractional row and column (the inverse mapping). Cells of the
    source that are absent or null take no part: the others' weights are scaled up. Nor do those of a weight up to 1e-12, which
    is the rounding of a place on a row or column of the source. Without any the value is null. Each
    target meets its four sources in one equi-join; the grids themselves never meet.
    """
    y, x = at(F.col("row"), F.col("col"))
    place = targets.select("row", "col", y.alias("y"), x.alias("x")).select("*", F.floor("y").alias("r"), F.floor("x").alias("c"))
    v, u = F.col("y") - F.col("r"), F.col("x") - F.col("c")
    corner = lambda r, c, w: F.struct((F.col("r") + r).alias("r"), (F.col("c") + c).alias("c"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - v) * (1 - u)), corner(0, 1, (1 - v) * u), corner(1, 0, v * (1 - u)), corner(1, 1, v * u))
    near = place.select("row", "col", F.explode(four).alias("n")).select("row", "col", "n.*").filter("w > 1e-12")
    have = source.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).cast("double").alias("v"))
    summed = near.join(have, ["r", "c"], "left").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("n"))
    return summed.select("row", "col", (F.col("s") / F.col("n")).alias("value"))
