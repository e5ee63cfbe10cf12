"""Terrain from an elevation grid: slope, aspect and curvature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import WindowTooLarge
from emberline.grid import CELL, GridSpec
from emberline.operators.tiles import halo_map


def _shift(a: np.ndarray, dy: int, dx: int, halo: int, shape) -> np.ndarray:
    return a[halo + dy:halo + dy + shape[0], halo + dx:halo + dx + shape[1]]


def horn(z: np.ndarray, res: float, halo: int, shape) -> tuple[np.ndarray, np.ndarray]:
    """Slope and downhill compass aspect in degrees by Horn's weights.

    Any unknown neighbour leaves both unknown; level ground has no aspect.
    """
    n = {(dy, dx): _shift(z, dy, dx, halo, shape) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    east = (n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]) / (8 * res)
    north = (n[-1, -1] + 2 * n[-1, 0] + n[-1, 1] - n[1, -1] - 2 * n[1, 0] - n[1, 1]) / (8 * res)
    known = ~np.isnan(n[0, 0])
    slope = np.where(known, np.degrees(np.arctan(np.hypot(east, north))), np.nan)
    aspect = np.degrees(np.arctan2(-east, -north)) % 360
    return slope, np.where(known & ((east != 0) | (north != 0)), aspect, np.nan)


def slope_aspect(cells: DataFrame, grid: GridSpec, dem: str) -> DataFrame:
    """Add ``slope`` and ``aspect`` to a grid."""
    res = grid.res

    def fn(arrays, shape):
        slope, aspect = horn(arrays[dem], res, 1, shape)
        return {"slope": slope, "aspect": aspect}

    src = cells.select(*CELL, F.col(dem).cast("double").alias(dem))
    return halo_map(src, grid, [dem], 1, fn, ["slope", "aspect"])


def curvature(cells: DataFrame, grid: GridSpec, dem: str, length_scale: float = 500.0) -> DataFrame:
    """Height above the mean of eight points at a distance, scaled to about [-0.5, 0.5].

    The scale is the largest absolute value of the processed extent, so results are
    comparable within one run only.
    """
    n = max(1, int(np.round(length_scale / grid.res)))
    if 2 * n + 1 > min(grid.nrow, grid.ncol):
        raise WindowTooLarge(f"length scale {length_scale} needs {2 * n + 1} cells")

    def fn(arrays, shape):
        z = arrays[dem]
        ring = sum(_shift(z, dy, dx, n, shape) for dy in (-n, 0, n) for dx in (-n, 0, n) if dy or dx)
        return {"raw": (_shift(z, 0, 0, n, shape) - ring / 8) / (2 * length_scale)}

    src = cells.select(*CELL, F.col(dem).cast("double").alias(dem))
    raw = halo_map(src, grid, [dem], n, fn, ["raw"])
    peak = raw.agg(F.greatest(F.max(F.abs("raw")), F.lit(1e-3)).alias("m")).scalar()
    return raw.select(*CELL, dem, (F.col("raw") / (2 * peak)).alias("curvature"))
