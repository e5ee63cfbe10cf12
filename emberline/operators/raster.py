"""Grid changes: polygons to cells, regridding, mosaics and trimming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.errors import EmberError, EmberWarning, notice
from emberline.grid import CELL, GridSpec


def polygon_edges(polygons: DataFrame, fid: str, rings: str) -> DataFrame:
    """One row per ring edge; rings close themselves."""
    ring = polygons.select(fid, F.explode(rings).alias("ring"))
    n = F.size("ring")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.element_at("ring", i).alias("p"), F.element_at("ring", F.when(i == n, F.lit(1)).otherwise(i + 1)).alias("q")))
    return ring.filter(n > 2).select(fid, F.explode(pairs).alias("e")).select(
        fid, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def _span(low: Column, high: Column) -> Column:
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))


def rasterize(polygons: DataFrame, grid: GridSpec, fid: str, rings: str = "rings", touches: bool = False) -> DataFrame:
    """Cells of each polygon: (fid, row, col), by cell centre or by any touch.

    Scanlines instead of point tests: every edge meets the row centres it spans, and
    the sorted meetings of a row pair up into column runs.  Work follows the length
    of the outlines plus the cells produced, and one huge polygon is spread by row.
    """
    edges = polygon_edges(polygons, fid, rings)
    res, ymax, xmin = float(grid.res), float(grid.ymax), float(grid.xmin)
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")
    # a row centre at height y is met when bottom <= y < top
    first = F.greatest(F.lit(0), F.floor((F.lit(ymax) - top) / res - 0.5) + 1)
    last = F.least(F.lit(grid.nrow - 1), F.floor((F.lit(ymax) - bottom) / res - 0.5))
    met = edges.select(fid, "x1", "y1", "x2", "y2", _span(first, last).alias("row"))
    at = F.col("x1") + (grid.y("row") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    xs = met.select(fid, "row", at.alias("x")).groupBy(fid, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    runs = xs.select(fid, "row", F.explode(F.transform(
        F.sequence(F.lit(1), F.expr("cast(size(xs) div 2 as int)")),
        lambda i: F.struct(F.element_at("xs", i * 2 - 1).alias("a"), F.element_at("xs", i * 2).alias("b")))).alias("r"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("r.a") - xmin) / res - 0.5))
    hi = F.least(F.lit(grid.ncol - 1), F.ceil((F.col("r.b") - xmin) / res - 0.5) - 1)
    inside = runs.select(fid, "row", _span(lo, hi).alias("col"))
    if not touches:
        return inside
    # every row band an edge passes through, and the columns it sweeps there
    r0 = F.greatest(F.lit(0), F.floor((F.lit(ymax) - top) / res))
    r1 = F.least(F.lit(grid.nrow - 1), F.floor((F.lit(ymax) - bottom) / res))
    band = edges.select(fid, "x1", "y1", "x2", "y2", _span(r0, r1).alias("row"))
    y_hi, y_lo = F.lit(ymax) - F.col("row") * res, F.lit(ymax) - (F.col("row") + 1) * res
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * slope

    flat = F.col("y1") == F.col("y2")
    xa = F.when(flat, F.col("x1")).otherwise(x_at(F.least(F.greatest("y1", "y2"), y_hi)))
    xb = F.when(flat, F.col("x2")).otherwise(x_at(F.greatest(F.least("y1", "y2"), y_lo)))
    c0 = F.greatest(F.lit(0), F.floor((F.least(xa, xb) - xmin) / res))
    c1 = F.least(F.lit(grid.ncol - 1), F.floor((F.greatest(xa, xb) - xmin) / res))
    return inside.union(band.select(fid, "row", _span(c0, c1).alias("col"))).distinct()


def burn_attribute(polygons: DataFrame, grid: GridSpec, fid: str, attrs: list[str], rings: str = "rings",
                   touches: bool = False) -> DataFrame:
    """One row per covered cell with the attributes of its polygon; the last feature wins."""
    hit = rasterize(polygons, grid, fid, rings, touches).groupBy(*CELL).agg(F.max(fid).alias(fid))
    return hit.join(polygons.select(fid, *attrs), fid)


def rectangle(x0, y0, x1, y1) -> Column:
    """A box as a one-ring polygon."""
    pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return F.array(F.array(*[F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                             for a, b in pts]))


def ring_area(rings) -> Column:
    """Area by the shoelace rule; holes wind the other way and subtract."""
    def one(ring: Column) -> Column:
        n = F.size(ring)
        idx = F.sequence(F.lit(1), n)

        def cross(acc: Column, i: Column) -> Column:
            p, q = F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
            return acc + p["x"] * q["y"] - q["x"] * p["y"]

        return F.aggregate(idx, F.lit(0.0), cross)

    return F.abs(F.aggregate(F.transform(rings, one), F.lit(0.0), lambda a, b: a + b)) / 2


def source_cell(source: GridSpec, target: GridSpec) -> tuple[Column, Column]:
    """Source row and column under the centre of a target cell."""
    return source.row_of(target.y("row")), source.col_of(target.x("col"))


def pick_method(categorical: bool, source: GridSpec, target: GridSpec, method: str | None = None) -> str:
    """Nearest for classes and refinement, average for coarsening, else as asked."""
    if categorical:
        if method not in (None, "near"):
            notice("a class layer is resampled by nearest neighbour only", EmberWarning)
        return "near"
    return method or ("near" if target.res < source.res else "average")


def scale_gap(grids: dict[str, GridSpec], direction: str = "finest") -> dict:
    """Target grid and how far the cell sizes are apart; driver metadata only."""
    pick = min if direction == "finest" else max
    name = pick(grids, key=lambda k: grids[k].res)
    ratio = max(g.res for g in grids.values()) / min(g.res for g in grids.values())
    return {"target": name, "grid": grids[name], "ratio": ratio, "cells_per_coarse_cell": ratio * ratio}


def align(cells: DataFrame, source: GridSpec, target: GridSpec, values: list[str], method: str = "near") -> DataFrame:
    """Put layers onto another grid of the same CRS; the only operator that may.

    ``near`` and ``bilinear`` look source cells up, tile by tile of the target; ``average``
    and ``sum`` push each source cell onto the targets it overlaps, weighted by area.
    """
    if source.crs != target.crs:
        raise EmberError("grids must share a CRS")
    if source == target:
        return cells.select(*CELL, *values)
    if method in ("near", "bilinear"):
        return _looked_up(cells, source, target, values, method)
    src = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), *values)
    if method not in ("average", "sum"):
        raise EmberError(f"unknown method '{method}'")
    x0 = F.lit(float(source.xmin)) + F.col("sc") * float(source.res)
    y1 = F.lit(float(source.ymax)) - F.col("sr") * float(source.res)
    box = src.select("*", x0.alias("x0"), (x0 + float(source.res)).alias("x1"), (y1 - float(source.res)).alias("y0"),
                     y1.alias("y1"))
    tiny = 1e-9
    c0 = F.greatest(F.lit(0), F.floor((F.col("x0") - target.xmin) / target.res + tiny))
    c1 = F.least(F.lit(target.ncol - 1), F.ceil((F.col("x1") - target.xmin) / target.res - tiny) - 1)
    r0 = F.greatest(F.lit(0), F.floor((F.lit(target.ymax) - F.col("y1")) / target.res + tiny))
    r1 = F.least(F.lit(target.nrow - 1), F.ceil((F.lit(target.ymax) - F.col("y0")) / target.res - tiny) - 1)
    hit = box.select("*", _span(r0, r1).alias("row")).select("*", _span(c0, c1).alias("col"))
    tx0, ty1 = F.lit(target.xmin) + F.col("col") * target.res, F.lit(target.ymax) - F.col("row") * target.res
    w = (F.least("x1", tx0 + target.res) - F.greatest("x0", tx0)) * (
        F.least("y1", ty1) - F.greatest("y0", ty1 - target.res)) / (source.res * source.res)
    hit = hit.select(*CELL, *values, w.alias("w"))
    if method == "sum":
        agg = [F.sum(F.col(v) * F.col("w")).alias(v) for v in values]
    else:
        agg = [(F.sum(F.col(v) * F.col("w")) / F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v) for v in values]
    return hit.groupBy(*CELL).agg(*agg)


#: Cells on a side of what a regridding task holds of the finer grid, at most.
REGRID_SIDE = 1024


def _weights(source: GridSpec, target: GridSpec, method: str, axis: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along one axis, for target rows or columns: first source index, weight of the next one, and whether there is any."""
    n = (source.nrow, source.ncol)[axis]
    if axis == 0:
        f = (source.ymax - (target.ymax - (at + 0.5) * target.res)) / source.res
    else:
        f = (target.xmin + (at + 0.5) * target.res - source.xmin) / source.res
    if method == "near":
        first = np.floor(f).astype("int64")
        return first, np.zeros(len(at)), (first >= 0) & (first < n)
    inside = (f >= 0) & (f <= n)
    f = np.clip(f - 0.5, 0, n - 1)
    first = np.floor(f).astype("int64")
    return first, f - first, inside


def _looked_up(cells: DataFrame, source: GridSpec, target: GridSpec, values: list[str], method: str) -> DataFrame:
    """Values by separable kernels over tiles of the target.

    Each source cell goes to the tiles that look it up, margins included; a tile finds the source rows and columns of its
    rows and columns and takes what stands where they cross.  A tile that no source cell reaches is all null.
    """
    spark = cells.sparkSession
    side = int(max(1, min(REGRID_SIDE // 2, REGRID_SIDE * source.res / target.res)))
    margin = source.res * (1 if method == "bilinear" else 0) + target.res

    def tiles(low: Column, high: Column, n: int) -> Column:
        """Tiles between two distances from the target's edge."""
        first = F.greatest(F.floor(low / target.res), F.lit(0))
        last = F.least(F.floor(high / target.res), F.lit(n - 1))
        return F.explode(F.when(first <= last, F.sequence((first / side).cast("int"), (last / side).cast("int"))))

    top = F.lit(float(target.ymax - source.ymax)) + F.col("row") * float(source.res)
    left = F.lit(float(source.xmin - target.xmin)) + F.col("col") * float(source.res)
    sent = cells.select(*CELL, *values, tiles(top - margin, top + source.res + margin, target.nrow).alias("tile_r")).select(
        "*", tiles(left - margin, left + source.res + margin, target.ncol).alias("tile_c"))
    down, across = -(-target.nrow // side), -(-target.ncol // side)
    every = spark.range(down * across).select(
        *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in [*CELL, *values]],
        F.expr(f"cast(id div {across} as int)").alias("tile_r"), F.expr(f"cast(id % {across} as int)").alias("tile_c"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r0, c0 = (k.as_py() * side for k in key)
        rows, cols = np.arange(r0, min(r0 + side, target.nrow)), np.arange(c0, min(c0 + side, target.ncol))
        table = table.filter(pc.is_valid(table["row"]))
        (fr, wr, okr), (fc, wc, okc) = (_weights(source, target, method, axis, at) for axis, at in enumerate((rows, cols)))
        low = (int(fr[okr].min()) if okr.any() else 0, int(fc[okc].min()) if okc.any() else 0)
        high = (int(fr[okr].max()) + 2 if okr.any() else 1, int(fc[okc].max()) + 2 if okc.any() else 1)
        place = np.full((high[0] - low[0], high[1] - low[1]), -1, "int64")
        sr, sc = (table[c].to_numpy().astype("int64") - low[k] for k, c in enumerate(CELL))
        held = (sr >= 0) & (sr < place.shape[0]) & (sc >= 0) & (sc < place.shape[1])
        place[sr[held], sc[held]] = np.flatnonzero(held)
        ir, ic = np.where(okr, fr - low[0], 0), np.where(okc, fc - low[1], 0)
        both = okr[:, None] & okc[None, :]
        out = {"row": np.repeat(rows, len(cols)).astype("int32"), "col": np.tile(cols, len(rows)).astype("int32")}
        if method == "near":
            at = np.where(both, place[np.ix_(ir, ic)], -1).ravel()
            picked = pa.array(at, mask=at < 0)
            return pa.table({**out, **{v: table[v].combine_chunks().take(picked) for v in values}})
        for v in values:
            flat = np.append(table[v].cast(pa.float64()).to_numpy(zero_copy_only=False), np.nan)
            known = np.where(np.append(pc.is_valid(table[v]).to_numpy(zero_copy_only=False), False), flat, np.nan)
            total, lacking = np.zeros(both.shape), ~both
            for dr in (0, 1):
                for dc in (0, 1):
                    w = np.outer(wr if dr else 1 - wr, wc if dc else 1 - wc)
                    corner = known[place[np.ix_(np.minimum(ir + dr, place.shape[0] - 1), np.minimum(ic + dc, place.shape[1] - 1))]]
                    lacking |= (w > 0) & np.isnan(corner)
                    total += np.where(w > 0, np.nan_to_num(corner) * w, 0.0)
            out[v] = pa.array(total.ravel(), mask=lacking.ravel())
        return pa.table(out)

    kinds = [cells.schema[v].dataType if method == "near" else T.DoubleType() for v in values]
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in CELL), *(T.StructField(v, k) for v, k in zip(values, kinds, strict=True))])
    return sent.unionByName(every).groupBy("tile_r", "tile_c").applyInArrow(run, schema)


def mosaic(tiles: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """One value per cell from overlapping tiles: the first that is not null wins."""
    return tiles.filter(F.col(value).isNotNull()).groupBy(*(by or []), *CELL).agg(
        F.min_by(value, order).alias(value))


def trim(cells: DataFrame, grid: GridSpec, area: DataFrame, fid: str, radius: float | None = None,
         box: tuple[float, float, float, float] | None = None, rings: str = "rings") -> DataFrame:
    """Keep the cells whose centre lies in the reporting area.

    ``box`` (xmin, ymin, xmax, ymax of the area) prunes before the exact test and lets
    the margin be compared with the radius without a job.
    """
    if box is not None:
        if radius is not None:
            slack = min(box[0] - grid.xmin, grid.xmax - box[2], box[1] - grid.ymin, grid.ymax - box[3])
            if slack < radius:
                notice(f"only {slack} of margin against a radius of {radius}: the edge frame reaches the area")
        cells = cells.filter(grid.x("col").between(box[0], box[2]) & grid.y("row").between(box[1], box[3]))
    kept = rasterize(area, grid, fid, rings).select(*CELL).distinct()
    return cells.join(kept, CELL, "left_semi")
