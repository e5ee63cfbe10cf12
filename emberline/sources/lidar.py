"""Point clouds and their tiles: coverage, density, metrics, fire check, batch plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.errors import EmptyResult, UnknownName, notice
from emberline.functions.constants import (
    LIDAR_FUEL_METRICS, LIDAR_MIN_DENSITY, LIDAR_NULL, LIDAR_PROFILE_BANDS, LIDAR_UNITS,
)
from emberline.grid import CELL, GridSpec


def _cells_of_box(grid: GridSpec, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Rows and columns whose centre lies in a half-open box, as arrays."""
    def span(lo: Column, hi: Column) -> Column:
        lo, hi = lo.cast("int"), hi.cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    c0 = F.greatest(F.lit(0), F.ceil((x0 - grid.xmin) / grid.res - 0.5))
    c1 = F.least(F.lit(grid.ncol - 1), F.ceil((x1 - grid.xmin) / grid.res - 0.5) - 1)
    r0 = F.greatest(F.lit(0), F.ceil((F.lit(grid.ymax) - y1) / grid.res - 0.5))
    r1 = F.least(F.lit(grid.nrow - 1), F.ceil((F.lit(grid.ymax) - y0) / grid.res - 0.5) - 1)
    return span(r0, r1), span(c0, c1)


def tile_coverage(index: DataFrame, area_cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Share of an area's cells that lie in at least one tile, with flight years and blocks."""
    rows, cols = _cells_of_box(grid, F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    tiles = index.select("name", "timestamp", "block", F.explode(rows).alias("row"), cols.alias("cs"))
    tiles = tiles.select("name", "timestamp", "block", "row", F.explode("cs").alias("col"))
    hit = area_cells.select(*CELL).distinct().join(
        tiles.groupBy(*CELL).agg(F.lit(True).alias("seen")), CELL, "left")
    share = hit.agg((100.0 * F.count("seen") / F.count("*")).alias("coverage_pct"))
    meta = index.agg(F.count("*").alias("n_tiles"),
                     F.array_sort(F.collect_set(F.substring("timestamp", 1, 4))).alias("years"),
                     F.count_distinct("block").alias("n_blocks"))
    return share.withColumn("m", meta.select(F.struct("n_tiles", "years", "n_blocks")).scalar()).select("coverage_pct", "m.*")


def density(points: DataFrame, by: list[str], area_m2: float, returns: str | None = "return_number") -> DataFrame:
    """Pulses and points per square metre of each tile or cell.

    Pulses are first returns; without return numbers, points stand in for them.
    """
    if returns is None or returns not in points.columns:
        notice("no return number: pulse density cannot be told from point density")
        pulses = F.count("*")
    else:
        pulses = F.count_if(F.col(returns) == 1)
    return points.groupBy(*by).agg(F.count("*").alias("n_points"), pulses.alias("n_pulses")).select(
        *by, "n_points", "n_pulses", F.bround(F.col("n_pulses") / area_m2, 2).alias("pulses_per_m2"),
        F.bround(F.col("n_points") / area_m2, 2).alias("points_per_m2"),
        (F.col("n_pulses") / area_m2 < LIDAR_MIN_DENSITY).alias("below_spec"))


def select_metrics(metrics: list[str] | str | None = None, profile: bool = False) -> list[str]:
    """Band names wanted: the fuel subset, all, or a checked list; maybe with the profile bands."""
    if metrics is None:
        base = list(LIDAR_FUEL_METRICS)
    elif metrics == "all":
        base = list(LIDAR_UNITS)
    else:
        unknown = sorted(set(metrics) - set(LIDAR_UNITS))
        if unknown:
            raise UnknownName(f"unknown metrics {unknown}")
        base = list(metrics)
    return base + ([f"CBD_{i + 1}" for i in range(LIDAR_PROFILE_BANDS)] if profile else [])


def check_bands(columns: list[str]) -> None:
    """Refuse a metric table whose bands are not those of the contract, by name."""
    lacking = [c for c in select_metrics("all", True) if c not in columns]
    if lacking:
        raise UnknownName(f"{len(lacking)} bands are missing, first {lacking[:3]}")


def clean_metrics(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Selected metrics with the 'not computed' marker turned into null."""
    return cells.select(*CELL, *[F.nullif(F.col(m).cast("double"), F.lit(float(LIDAR_NULL))).alias(m) for m in metrics])


def metric_units(metrics: list[str]) -> dict[str, str | None]:
    return {m: "kg/m3" if m.startswith("CBD_") else LIDAR_UNITS[m] for m in metrics}


def _bins(width: float, x0: str, y0: str, x1: str, y1: str):
    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))

    return span(x0, x1), span(y0, y1)


def outline_meets_box(rings: Column, box: tuple[str, str, str, str]) -> Column:
    """Whether a polygon shares area with a box: an edge runs through it, or it lies inside the outline.

    A shared border alone is no meeting.
    """
    x0, y0, x1, y1 = (F.col(c) for c in box)

    def edges(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)),
                          lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))

    def span(p: Column, q: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        """Share of the edge, from 0 to 1, between two sides of the box; an edge along them is all in or all out."""
        d = q - p
        level, inside = d == 0, (p > lo) & (p < hi)
        return (F.when(level, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least((lo - p) / d, (hi - p) / d)),
                F.when(level, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest((lo - p) / d, (hi - p) / d)))

    def through(e: Column) -> Column:
        ax, bx = span(e["px"], e["qx"], x0, x1)
        ay, by = span(e["py"], e["qy"], y0, y1)
        return F.greatest(F.lit(0.0), ax, ay) < F.least(F.lit(1.0), bx, by)

    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2

    def left_of(e: Column) -> Column:
        spans = (e["py"] > cy) != (e["qy"] > cy)
        return spans & (cx < e["px"] + (cy - e["py"]) * (e["qx"] - e["px"]) / F.nullif(e["qy"] - e["py"], F.lit(0.0)))

    everything = F.flatten(F.transform(rings, edges))
    return F.exists(everything, through) | (F.size(F.filter(everything, left_of)) % 2 == 1)


def fire_check(windows: DataFrame, fires: DataFrame, wid: str = "name", width: float = 1000.0) -> DataFrame:
    """Finished windows that meet a burn, and whether any burn came after the flight.

    Boxes meet through shared bins, so no window is compared with every fire; where fires carry ``rings``, a pair
    whose boxes meet is then tested against the outline itself.
    """
    wx, wy = _bins(width, "xmin", "ymin", "xmax", "ymax")
    w = windows.select(wid, "xmin", "ymin", "xmax", "ymax", "flight_year", wx.alias("bx")).select("*", wy.alias("by"))
    outline = ["rings"] if "rings" in fires.columns else []
    f = fires.select(F.col("xmin").alias("fx0"), F.col("ymin").alias("fy0"), F.col("xmax").alias("fx1"), F.col("ymax").alias("fy1"),
                     "fire_id", "fire_year", *outline)
    fx, fy = _bins(width, "fx0", "fy0", "fx1", "fy1")
    f = f.select("*", fx.alias("bx")).select("*", fy.alias("by"))
    meets = (F.col("fx0") < F.col("xmax")) & (F.col("fx1") > F.col("xmin")) & (F.col("fy0") < F.col("ymax")) & (F.col("fy1") > F.col("ymin"))
    # a pair is kept in the one bin that holds the corner of its overlap
    own = (F.col("bx") == F.floor(F.greatest("xmin", "fx0") / width)) & (F.col("by") == F.floor(F.greatest("ymin", "fy0") / width))
    pairs = w.join(f, ["bx", "by"]).filter(meets & own)
    if outline:
        pairs = pairs.filter(outline_meets_box(F.col("rings"), ("xmin", "ymin", "xmax", "ymax")))
    return pairs.groupBy(wid).agg(F.count("*").alias("n_fires"), F.max("fire_year").alias("last_fire"),
                                  F.max(F.coalesce(F.col("fire_year") > F.col("flight_year"), F.lit(False))).alias("burnt_after_flight"))


def batch_plan(index: DataFrame, manifest: DataFrame, area: tuple[float, float, float, float], tile: str = "name") -> DataFrame:
    """Every tile with what remains to be done: outside the area, done before, or to do."""
    inside = (F.col("xmin") < area[2]) & (F.col("xmax") > area[0]) & (F.col("ymin") < area[3]) & (F.col("ymax") > area[1])
    done = manifest.filter(F.col("status").isin("done", "written")).select(tile).distinct().withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "done").when(~inside, "outside").otherwise("todo")
    return index.join(done, tile, "left").withColumn("status", status).drop("_done")


def append_manifest(rows: DataFrame, path: str) -> None:
    """Record finished tiles; the next plan skips them."""
    rows.select("name", "status", "points", "seconds", "path", "error").write.mode("append").parquet(path)


def require_tiles(plan: DataFrame) -> DataFrame:
    todo = plan.filter(F.col("status") == "todo")
    if todo.isEmpty():
        raise EmptyResult("every tile is done or outside the area")
    return todo
