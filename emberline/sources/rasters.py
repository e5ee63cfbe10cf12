"""Continuous rasters: elevation, population, forest structure and gridded danger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.errors import RoleRefused
from emberline.functions.scalars import metric_tile_key, tile_key
from emberline.grid import CELL, GridSpec, Layer
from emberline.operators.provenance import Provenance
from emberline.operators.raster import align, mosaic
from emberline.session import hold


def elevation(tiles: DataFrame, source: GridSpec, target: GridSpec, value: str = "elev", order: str = "tile") -> DataFrame:
    """Elevation tiles as one grid, bilinear on the working grid."""
    return align(mosaic(tiles, value, order), source, target, [value], "bilinear")


def elevation_range(cells: DataFrame, value: str = "elev") -> DataFrame:
    return cells.agg(F.min(value).alias("elev_min"), F.max(value).alias("elev_max"), F.count(value).alias("n"))


def population(cells: DataFrame, source: GridSpec, target: GridSpec, value: str = "pop") -> DataFrame:
    """Head counts on another grid, shared out by area so that the total is kept."""
    return align(cells, source, target, [value], "sum")


def population_drift(before: DataFrame, after: DataFrame, value: str = "pop") -> DataFrame:
    """Totals before and after regridding and the drift in percent."""
    b = before.agg(F.sum(value)).scalar()
    return after.agg(F.sum(value).alias("after")).select(
        b.alias("before"), "after", (100 * (F.col("after") - b) / F.greatest(b, F.lit(1.0))).alias("drift_pct"))


def structure(cells: DataFrame, source: GridSpec, target: GridSpec, variable: str, units: str, vintage: int = 2020) -> Layer:
    """Forest height, biomass or volume on the working grid; a class layer is refused."""
    if dict(cells.dtypes)[variable] == "string":
        raise RoleRefused(f"'{variable}' is a class layer")
    prov = Provenance().source("forest_structure", vintage=vintage).step("structure", {"variable": variable, "res": target.res})
    return Layer(align(cells, source, target, [variable], "bilinear"), target, variable, "metric", units, prov)


def block_key(row: Column, col: Column, side: int) -> Column:
    """Name of the square block of cells that holds a cell."""
    return F.concat_ws("_", F.floor(row / side).cast("int"), F.floor(col / side).cast("int"))


def write_dated(df: DataFrame, path: str, side: int = 512) -> None:
    """Land a ``(date, row, col, value)`` series under its dates and square blocks of cells.

    Rows are dealt by ranges of date, block and cell, so a crowded date is written by as many tasks as it calls for.
    """
    keyed = df.select("date", block_key(F.col("row"), F.col("col"), side).alias("block"), *CELL, "value")
    keyed.repartitionByRange("date", "block", *CELL).write.mode("overwrite").partitionBy("date", "block").parquet(path)


def blocks_of_area(area: DataFrame, grid: GridSpec, side: int = 512, rings: str = "rings") -> DataFrame:
    """Blocks that the boxes of an area's polygons meet, a row each (``tr``, ``tc``, ``block``)."""
    def ends(axis: str) -> tuple[Column, Column]:
        v = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[axis])))
        return F.array_min(v), F.array_max(v)

    (x0, x1), (y0, y1) = ends("x"), ends("y")
    res, last = float(grid.res), [(n - 1) // side for n in (grid.nrow, grid.ncol)]

    def span(low: Column, high: Column, top: int) -> Column:
        first = F.greatest(F.floor(F.floor(low / res) / side), F.lit(0))
        end = F.least(F.floor((F.ceil(high / res) - 1) / side), F.lit(top))
        return F.explode(F.when(first <= end, F.sequence(first.cast("int"), end.cast("int"))))

    met = area.select(span(F.lit(float(grid.ymax)) - y1, F.lit(float(grid.ymax)) - y0, last[0]).alias("tr"),
                      (x0 - float(grid.xmin)).alias("_l"), (x1 - float(grid.xmin)).alias("_h"))
    return met.select("tr", span(F.col("_l"), F.col("_h"), last[1]).alias("tc")).distinct().withColumn(
        "block", F.concat_ws("_", "tr", "tc"))


def danger_series(spark: SparkSession, path: str, first: str | None = None, last: str | None = None,
                  blocks: DataFrame | None = None) -> DataFrame:
    """A landed ``(date, row, col, value)`` series; dates prune folders when planned, ``blocks`` of an area while it runs."""
    df = spark.read.parquet(path)
    if blocks is not None:
        # Written once, so its size is known: a small area is broadcast and prunes the scan.
        df = df.join(hold(blocks.select("tr", "block"), "area-blocks").filter("tr >= 0"), "block").drop("tr", "block")
    df = df.select(F.col("date").cast("date").alias("date"), *CELL, F.col("value").cast("double").alias("value"))
    if first is not None:
        df = df.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(F.col("date") <= F.lit(last).cast("date"))
    return df


def write_tiled(df: DataFrame, path: str, key: str = "tile") -> None:
    """Write cells or points under their tile key, so an area of interest prunes files.

    Rows are dealt by ranges of key and the other columns before writing: sampled bounds
    give a crowded tile to as many tasks as its rows call for, and others share one.
    """
    df.repartitionByRange(key, *[c for c in df.columns if c != key]).write.mode("overwrite").partitionBy(key).parquet(path)


def with_degree_tile(df: DataFrame, lon: str, lat: str, step: int = 3) -> DataFrame:
    return df.withColumn("tile", tile_key(lon, lat, step))


def with_metric_tile(df: DataFrame, x: str, y: str, x0: float, y_top: float, side: float = 1_000_000.0, first_col: int = 1) -> DataFrame:
    return df.withColumn("tile", metric_tile_key(x, y, x0, y_top, side, first_col))


def tiles_of_box(spark: SparkSession, box: tuple[float, float, float, float], step: int = 3) -> DataFrame:
    """Keys of the degree tiles a lon/lat box meets."""
    def span(lo: float, hi: float):
        return F.explode(F.sequence(F.floor(F.lit(lo) / step), F.floor(F.lit(hi) / step)))

    base = spark.range(1).select(span(box[0], box[2]).alias("i")).select("i", span(box[1], box[3]).alias("j"))
    return base.select(tile_key(F.col("i") * step, F.col("j") * step, step).alias("tile"), (F.col("i") * step).alias("xmin"),
                       (F.col("j") * step).alias("ymin")).orderBy("tile")
