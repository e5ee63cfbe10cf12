"""Directional vulnerability of many assets: transects through the exposure layer."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.errors import BadRange, EmberError
from emberline.functions.constants import BEARING_STEP, EXPOSURE_FLOOR, SEGMENTS_M, VIABLE_SHARE
from emberline.grid import CELL, GridSpec
from emberline.operators.tiles import tile_side, with_halo
from emberline.session import hold


#: Assets that one task follows the bearings of, on average at most.
TASK_ASSETS = 512


def transect_spots(segments: list[float], step: float) -> tuple[np.ndarray, np.ndarray]:
    """Segment number and distance of each sample along a bearing."""
    seg, at, start = [], [], 0.0
    for k, length in enumerate(segments):
        d = start + step / 2
        while d <= start + length + 1e-9:
            seg.append(k + 1)
            at.append(d)
            d += step
        start += length
    return np.array(seg, "int64"), np.array(at, "float64")


def directional(assets: DataFrame, exposure: DataFrame, grid: GridSpec, asset: str = "asset", value: str = "exposure",
                segments: list[float] = SEGMENTS_M, interval: float = BEARING_STEP, step: float | None = None,
                thresh_exp: float = EXPOSURE_FLOOR, thresh_viable: float = VIABLE_SHARE) -> DataFrame:
    """Share of high exposure and viability per asset, bearing and segment.

    Samples without a value are dropped; a segment without samples is undecided and
    its bearing is not viable.  ``pct_missing`` tells how much of a bearing was unmapped.

    Assets meet the layer tile by tile, with a margin as wide as a transect is long; samples are looked up inside the
    tile and leave it as one row an asset and bearing.  Assets of a crowded tile are dealt over several tasks.
    """
    if any(s <= 0 for s in segments):
        raise BadRange("segments must be positive")
    if not (0 <= thresh_exp <= 1 and 0 <= thresh_viable <= 1):
        raise BadRange("thresholds must lie in [0, 1]")
    outside = ~(F.col("x").between(grid.xmin, grid.xmax) & F.col("y").between(grid.ymin, grid.ymax))
    if not assets.filter(outside).isEmpty():
        raise EmberError("an asset lies outside the layer")
    seg, at = transect_spots(list(segments), step or grid.res)
    turns = np.arange(1, round(360 / interval) + 1) * float(interval)
    east, north = np.sin(np.radians(turns)), np.cos(np.radians(turns))
    halo = math.ceil(at.max(initial=0.0) / grid.res) + 1
    side = tile_side(grid, halo)
    tile = ["tile_r", "tile_c"]
    last = [(n - 1) // side for n in (grid.nrow, grid.ncol)]
    spots = assets.select(F.col(asset).alias("asset"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[
        F.least(F.floor(c / side), F.lit(n)).cast("int").alias(t) for c, n, t in zip((grid.row_of("y"), grid.col_of("x")), last, tile, strict=True)])
    dealt = hold(spots.groupBy(*tile).agg(F.ceil(F.count("*") / TASK_ASSETS).cast("int").alias("tasks")), "transect-tiles")
    here = spots.join(dealt, tile).withColumn("task", F.pmod(F.xxhash64("asset", "x", "y"), F.col("tasks")).cast("int")).drop("tasks")
    layer = with_halo(exposure.select(*CELL, F.col(value).cast("double").alias("e")), grid, side, halo).join(dealt, tile).select(
        *CELL, "e", *tile, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    raws = [f"raw{k}" for k in range(1, len(segments) + 1)]

    def follow(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in ("asset", "bearing", *raws, "pct_missing")})
        r0, c0 = int(own["tile_r"].iloc[0]) * side - halo, int(own["tile_c"].iloc[0]) * side - halo
        a = np.full((side + 2 * halo + 2,) * 2, np.nan)
        a[cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0] = cells["e"].to_numpy("float64", na_value=np.nan)
        out = []
        for name, x, y in zip(own["asset"], own["x"], own["y"], strict=True):
            row = np.floor((grid.ymax - (y + at[None, :] * north[:, None])) / grid.res).astype("int64") - r0
            col = np.floor((x + at[None, :] * east[:, None] - grid.xmin) / grid.res).astype("int64") - c0
            e = a[row, col]
            known = ~np.isnan(e)
            one = {"asset": [name] * len(turns), "bearing": turns}
            for k, raw in enumerate(raws):
                of = known[:, seg == k + 1]
                high = (e[:, seg == k + 1] >= thresh_exp) & of
                with np.errstate(invalid="ignore"):
                    one[raw] = high.sum(axis=1) / of.sum(axis=1)
            one["pct_missing"] = 100.0 * (~known).sum(axis=1) / max(len(seg), 1)
            out.append(pd.DataFrame(one))
        return pd.concat(out, ignore_index=True)

    kind = assets.schema[asset].dataType.simpleString()
    schema = f"asset {kind}, bearing double, {', '.join(f'{r} double' for r in raws)}, pct_missing double"
    by = [*tile, "task"]
    got = here.groupBy(*by).cogroup(layer.groupBy(*by)).applyInPandas(follow, schema).withColumns(
        {r: F.nullif(r, F.lit(float("nan"))) for r in raws})
    all_ok, cols = F.lit(True), []
    for k in range(1, len(segments) + 1):
        seg = F.col(f"raw{k}") >= thresh_viable
        cols += [seg.alias(f"seg{k}"), F.bround(f"raw{k}", 4).alias(f"frac{k}")]
        all_ok = all_ok & F.coalesce(seg, F.lit(False))
    return got.select("asset", "bearing", *cols, all_ok.alias("viable"), "pct_missing")


def bearing_ranges(table: DataFrame) -> DataFrame:
    """Runs of consecutive viable bearings per asset; an asset has at most 360 / interval rows."""
    w = Window.partitionBy("asset").orderBy("bearing")
    new = F.when(F.col("bearing") - F.lag("bearing").over(w) > 1, 1).otherwise(0)
    runs = table.filter("viable").select("asset", "bearing", new.alias("n"))
    runs = runs.withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("asset", "run").agg(F.min("bearing").alias("first"), F.max("bearing").alias("last")).select(
        "asset", "first", "last")
