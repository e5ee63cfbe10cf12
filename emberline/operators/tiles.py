"""Halo tiles: one shuffle that gives each tile the margin its window needs.

A tile holds at most (side + 2 * halo)^2 cells whatever the grid size, so the
group handed to a task is bounded by construction; the number of tiles is what
grows.  Inside a tile the work is dense array arithmetic.
"""

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.grid import CELL, GridSpec


def tile_side(grid: GridSpec, halo: int) -> int:
    """Side that keeps the replicated margin small and a dense tile near a few MB."""
    side = max(128, min(1024, 8 * halo))
    return min(side, max(grid.nrow, grid.ncol))


def with_halo(df: DataFrame, grid: GridSpec, side: int, halo: int) -> DataFrame:
    """Copy each cell to every tile whose margin reaches it: one copy for most cells."""
    def span(c: str, n: int):
        first = F.greatest(F.lit(0), F.floor((F.col(c) - halo) / side)).cast("int")
        last = F.least(F.lit((n - 1) // side), F.floor((F.col(c) + halo) / side)).cast("int")
        return F.explode(F.sequence(first, last))

    return df.withColumn("tile_r", span("row", grid.nrow)).withColumn("tile_c", span("col", grid.ncol))


def halo_map(
    df: DataFrame,
    grid: GridSpec,
    values: list[str],
    halo: int,
    fn: Callable[[dict[str, np.ndarray], tuple[int, int]], dict[str, np.ndarray]],
    outputs: list[str],
    side: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Apply ``fn`` to dense padded tiles and return its outputs for the cells present.

    ``fn`` gets padded arrays (absent and null cells are NaN) with the position of
    the core, and returns arrays of core shape.  ``keep`` columns pass through.
    """
    side = side or tile_side(grid, halo)
    keep = values if keep is None else keep
    cols = list(dict.fromkeys(values + keep))
    nrow, ncol = grid.nrow, grid.ncol

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * side - halo, key[1] * side - halo
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        core = (r >= halo) & (r < halo + side) & (c >= halo) & (c < halo + side)
        if not core.any():
            return pd.DataFrame({n: pd.Series(dtype="float64") for n in [*CELL, *keep, *outputs]})
        height = min(side, nrow - key[0] * side)
        width = min(side, ncol - key[1] * side)
        arrays = {}
        for v in values:
            a = np.full((height + 2 * halo, width + 2 * halo), np.nan)
            a[r, c] = pdf[v].to_numpy(dtype="float64", na_value=np.nan)
            arrays[v] = a
        res = fn(arrays, (height, width))
        rr, cc = r[core] - halo, c[core] - halo
        out = {"row": pdf["row"].to_numpy()[core], "col": pdf["col"].to_numpy()[core]}
        for k in keep:
            out[k] = pdf[k].to_numpy()[core]
        for name in outputs:
            out[name] = np.asarray(res[name], dtype="float64")[rr, cc]
        return pd.DataFrame(out)

    fields = [T.StructField(c, T.IntegerType()) for c in CELL]
    fields += [df.schema[k] for k in keep]
    fields += [T.StructField(n, T.DoubleType()) for n in outputs]
    tiled = with_halo(df.select(*CELL, *cols), grid, side, halo)
    return tiled.groupBy("tile_r", "tile_c").applyInPandas(run, T.StructType(fields))


def row_prefix(a: np.ndarray) -> np.ndarray:
    """Running row totals with a leading zero column."""
    out = np.zeros((a.shape[0], a.shape[1] + 1))
    np.cumsum(a, axis=1, out=out[:, 1:])
    return out


def run_sums(prefix: np.ndarray, runs, halo: int, shape: tuple[int, int]) -> np.ndarray:
    """Window totals of every core cell from horizontal runs."""
    h, w = shape
    acc = np.zeros(shape)
    for dy, lo, hi in runs:
        band = prefix[halo + dy:halo + dy + h]
        acc += band[:, halo + hi + 1:halo + hi + 1 + w]
        acc -= band[:, halo + lo:halo + lo + w]
    return acc
