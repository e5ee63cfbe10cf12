"""Neighbourhood operators: exposure, directional exposure, interface, radius sweep."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import BadRange, EmberError
from emberline.functions.constants import EXPOSURE_RADII
from emberline.functions.scalars import clamp, unit_or_error
from emberline.grid import CELL, GridSpec
from emberline.operators import windows as win
from emberline.operators.terrain import horn
from emberline.operators.tiles import halo_map, row_prefix, run_sums



def focal_sums(
    df: DataFrame,
    grid: GridSpec,
    values: list[str],
    kernels: dict[str, win.Offsets],
    side: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Sum and count of non-null values in every kernel, for every cell present.

    All columns and kernels share one shuffle.  Output columns are
    ``{value}_{kernel}_sum`` and ``{value}_{kernel}_n``.  Sums keep nine decimals: a
    running total carries noise of the cells before it, and equal neighbourhoods must
    stay equal wherever they lie, or ranks would see ties broken.
    """
    halo = max(win.reach_of(o) for o in kernels.values())
    runs = {k: win.to_runs(o) for k, o in kernels.items()}

    def fn(arrays, shape):
        out = {}
        for v, a in arrays.items():
            known = ~np.isnan(a)
            total, count = row_prefix(np.where(known, a, 0.0)), row_prefix(known.astype("float64"))
            for k, r in runs.items():
                out[f"{v}_{k}_sum"] = np.round(run_sums(total, r, halo, shape), 9)
                out[f"{v}_{k}_n"] = run_sums(count, r, halo, shape)
        return out

    names = [f"{v}_{k}_{s}" for v in values for k in kernels for s in ("sum", "n")]
    return halo_map(df, grid, values, halo, fn, names, side, keep)


def focal_sums_by_offset(df: DataFrame, grid: GridSpec, value: str, offsets: win.Offsets) -> DataFrame:
    """The same totals by shifting each cell along a literal offset list.

    The fan-out is the ring size, so this is for small rings; it needs no Python.
    """
    moves = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(False).alias("own"))
                      for dy, dx in offsets],
                    F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(True).alias("own")))
    shifted = df.select(*CELL, F.col(value).alias("v"), F.explode(moves).alias("m")).select(
        (F.col("row") + F.col("m.dy")).alias("row"), (F.col("col") + F.col("m.dx")).alias("col"),
        F.when(~F.col("m.own"), F.col("v")).alias("v"), F.when(F.col("m.own"), F.col("v")).alias("mine"),
        F.col("m.own").alias("own"))
    return (
        shifted.filter(grid.inside()).groupBy(*CELL)
        .agg(F.max("mine").alias(value), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"),
             F.count("v").alias("n"), F.max("own").alias("present"))
        .filter("present").drop("present")
    )


def focal_sums_by_prefix(df: DataFrame, grid: GridSpec, value: str, offsets: win.Offsets) -> DataFrame:
    """The same totals from row prefix sums, each run costing two look-ups.

    Fan-out is twice the number of window rows instead of the ring size.  Rows are
    completed with empty cells, and padded past the edge so that every run end exists.
    """
    from pyspark.sql.window import Window

    runs = win.to_runs(offsets)
    pad = win.reach_of(offsets) + 1
    wide = grid.ncol + 2 * pad
    lattice = df.sparkSession.range(grid.nrow * wide).select(
        F.expr(f"id div {wide}").cast("int").alias("row"), (F.expr(f"id % {wide}") - pad).cast("int").alias("col"))
    along = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    dense = lattice.join(df.select(*CELL, F.col(value).alias("v"), F.lit(True).alias("own")), CELL, "left")
    prefix = dense.select(*CELL, "v", "own", F.sum(F.coalesce("v", F.lit(0.0))).over(along).alias("s"),
                          F.count("v").over(along).alias("k"))
    ends = F.array(
        *[F.struct(F.lit(-dy).alias("dy"), F.lit(-hi).alias("dx"), F.lit(1).alias("sign")) for dy, _, hi in runs],
        *[F.struct(F.lit(-dy).alias("dy"), F.lit(1 - lo).alias("dx"), F.lit(-1).alias("sign")) for dy, lo, _ in runs],
        F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(0).alias("sign")))
    moved = prefix.select("*", F.explode(ends).alias("e")).select(
        (F.col("row") + F.col("e.dy")).alias("row"), (F.col("col") + F.col("e.dx")).alias("col"),
        (F.col("s") * F.col("e.sign")).alias("s"), (F.col("k") * F.col("e.sign")).alias("k"),
        F.when(F.col("e.sign") == 0, F.col("v")).alias("mine"),
        ((F.col("e.sign") == 0) & F.col("own")).alias("own"))
    return (
        moved.filter(grid.inside()).groupBy(*CELL)
        .agg(F.max("mine").alias(value), F.round(F.sum("s"), 9).alias("sum"), F.sum("k").alias("n"), F.max("own").alias("present"))
        .filter("present").drop("present")
    )


def exposure_share(total, count, n_ring: int, na_rm: bool):
    """Ring total over the full ring size; null where the ring is not wholly known."""
    share = clamp(F.col(total) / n_ring, 0, 1)
    return share if na_rm else F.when(F.col(count) == n_ring, share)


def exposure(
    cells: DataFrame,
    grid: GridSpec,
    value: str,
    radius: float | None = None,
    kind: str = "ember",
    na_rm: bool = False,
    no_burn: DataFrame | None = None,
    strategy: str = "tiles",
    out: str = "exposure",
) -> DataFrame:
    """Share of hazardous ground in the annulus around each cell.

    With ``na_rm`` the known part of a ring still counts against its full size, so
    edges are understated rather than rescaled.  ``no_burn`` masks the result only.
    """
    radius = EXPOSURE_RADII[kind][1] if radius is None else radius
    win.check_radius(grid, radius)
    ring = win.annulus(grid.res, radius)
    src = cells.select(*CELL, unit_or_error(F.col(value).cast("double"), value).alias(value))
    if strategy == "tiles":
        sums = focal_sums(src, grid, [value], {"ring": ring}).withColumnsRenamed(
            {f"{value}_ring_sum": "sum", f"{value}_ring_n": "n"})
    elif strategy == "prefix":
        sums = focal_sums_by_prefix(src, grid, value, ring)
    elif strategy == "offsets":
        sums = focal_sums_by_offset(src, grid, value, ring)
    else:
        raise EmberError(f"unknown strategy '{strategy}'")
    res = sums.select(*CELL, value, exposure_share("sum", "n", len(ring), na_rm).alias(out))
    return res if no_burn is None else mask_no_burn(res, no_burn, out)


def mask_no_burn(cells: DataFrame, no_burn: DataFrame, value: str) -> DataFrame:
    """Blank a result where the mask is 1; a mask may hold nothing but 1 and null."""
    m = F.col("no_burn")
    checked = F.when(m.isNull() | (m == 1), m).otherwise(F.raise_error(F.lit("no_burn must be 1 or null")).cast("int"))
    mask = no_burn.select(*CELL, checked.alias("no_burn"))
    blanked = F.when(F.col("no_burn").isNull(), F.col(value))
    return cells.join(mask, CELL, "left").withColumn(value, blanked).drop("no_burn")


def sector_base(counts: list[int], bearings: list[float], wind: float | None, kappa_wind: float) -> list[float]:
    """Weight of each sector: its share of the ring, tilted toward the wind."""
    w = np.array(counts, dtype="float64") / sum(counts)
    if wind is not None and kappa_wind > 0:
        w = w * np.exp(kappa_wind * np.cos(np.radians(np.array(bearings) - wind)))
        w = w / w.sum()
    return w.tolist()


def exposure_directional_weighted(
    cells: DataFrame,
    grid: GridSpec,
    value: str,
    radius: float,
    wind: float | None = None,
    kappa_wind: float = 0.0,
    dem: str | None = None,
    kappa_slope: float = 0.0,
    n_sectors: int = 8,
    na_rm: bool = False,
    out: str = "exposure",
) -> DataFrame:
    """Exposure with sectors weighted by wind and by the slope at each cell.

    Zero concentrations give :func:`exposure` exactly.  Sector sums and terrain come
    from the same tile, so the whole operator is one shuffle.
    """
    if kappa_wind < 0 or kappa_slope < 0 or n_sectors < 2:
        raise BadRange("kappas must be non-negative and n_sectors at least 2")
    if grid.res > radius / 3:
        win.check_radius(grid, radius)
    parts, bearings = win.sectors(grid.res, radius, n_sectors)
    kept = [(o, b) for o, b in zip(parts, bearings) if o]
    counts = [len(o) for o, _ in kept]
    base = sector_base(counts, [b for _, b in kept], wind, kappa_wind)
    halo = max(win.reach_of(o) for o, _ in kept)
    runs = [win.to_runs(o) for o, _ in kept]
    angles = [math.radians(b) for _, b in kept]
    sloped = dem is not None and kappa_slope > 0
    res = grid.res

    def fn(arrays, shape):
        a = arrays[value]
        known = ~np.isnan(a)
        total, count = row_prefix(np.where(known, a, 0.0)), row_prefix(known.astype("float64"))
        if sloped:
            slope, aspect = horn(arrays[dem], res, halo, shape)
            pull = kappa_slope * np.tan(np.radians(slope))
            tilt = [np.exp(pull * np.cos(t - np.radians(aspect))) for t in angles]
            tilt = [np.where(np.isnan(aspect) & (slope == 0), 1.0, t) for t in tilt]
        acc, norm = np.zeros(shape), np.zeros(shape)
        for i, r in enumerate(runs):
            share = run_sums(total, r, halo, shape) / counts[i]
            if not na_rm:
                share = np.where(run_sums(count, r, halo, shape) == counts[i], share, np.nan)
            w = base[i] * tilt[i] if sloped else base[i]
            acc, norm = acc + share * w, norm + w
        return {out: np.clip(acc / norm, 0, 1)}

    inputs = [value] + ([dem] if sloped else [])
    src = cells.select(*CELL, *[F.col(c).cast("double").alias(c) for c in inputs])
    return halo_map(src, grid, inputs, halo, fn, [out], keep=[value])


def interface(
    cells: DataFrame,
    grid: GridSpec,
    asset: str,
    fuel: str,
    distance: float = 100.0,
    assets_min: float = 0.0,
    side: str = "assets",
    out: str = "wui",
) -> DataFrame:
    """Wildland-urban interface: assets with fuel near, fuel with assets near, or both.

    Null counts as "nothing here" on both layers.  Both neighbourhood tests share
    one tile pass.
    """
    if distance < grid.res:
        raise BadRange(f"distance {distance} is below the cell size {grid.res}")
    if side not in ("assets", "fuel", "both"):
        raise EmberError("side must be assets, fuel or both")
    flags = cells.select(
        *CELL,
        F.coalesce((F.col(asset) > assets_min).cast("double"), F.lit(0.0)).alias("a"),
        F.coalesce((F.col(fuel) > 0).cast("double"), F.lit(0.0)).alias("f"))
    near = focal_sums(flags, grid, ["a", "f"], {"near": win.disc(grid.res, distance)})
    at_assets = (F.col("a") > 0) & (F.col("f_near_sum") > 0)
    at_fuel = (F.col("f") > 0) & (F.col("a_near_sum") > 0)
    flag = {"assets": at_assets, "fuel": at_fuel, "both": at_assets | at_fuel}[side]
    return near.select(*CELL, flag.cast("int").alias(out))


def exposure_sweep(cells: DataFrame, grid: GridSpec, value: str, radii: list[float], na_rm: bool = False) -> DataFrame:
    """Exposure at several radii from one tile pass, in long form (radius, row, col, exposure)."""
    rings = {f"r{i}": win.annulus(grid.res, r) for i, r in enumerate(radii)}
    src = cells.select(*CELL, unit_or_error(F.col(value).cast("double"), value).alias(value))
    wide = focal_sums(src, grid, [value], rings)
    each = F.array(*[
        F.struct(F.lit(float(r)).alias("radius"),
                 exposure_share(f"{value}_r{i}_sum", f"{value}_r{i}_n", len(rings[f"r{i}"]), na_rm).alias("exposure"))
        for i, r in enumerate(radii)])
    return wide.select(*CELL, F.inline(each))


def gap_bound(components: DataFrame, grid: GridSpec, radius: float) -> DataFrame:
    """How many result cells the null gaps can blank at most: gaps times window, capped at the grid."""
    window = math.ceil(math.pi * (radius / grid.res) ** 2)
    gaps = F.count_distinct("component")
    return components.agg(
        F.count("*").alias("null_cells"), gaps.alias("gaps"),
        F.least(gaps * F.lit(window), F.lit(grid.ncell)).alias("bound_cells"))
