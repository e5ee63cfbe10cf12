"""Land cover: class polygons, class rasters and the vintage of a forest survey."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.errors import EmptyResult, UnknownName, notice
from emberline.functions.constants import SURVEY_WINDOW
from emberline.grid import CELL, GridSpec
from emberline.operators.raster import burn_attribute, mosaic


def class_column(columns: list[str], wanted: str | None = None) -> str:
    """The class column: as named, else the one that looks like ``code_NN``."""
    if wanted is not None:
        if wanted not in columns:
            raise UnknownName(f"no column '{wanted}'")
        return wanted
    hit = [c for c in columns if re.fullmatch(r"code_[0-9]{2}", c)]
    if len(hit) != 1:
        raise UnknownName(f"cannot tell the class column among {columns}")
    return hit[0]


def polygons_in_box(polygons: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Prune polygons whose bounding box misses the area; the columns are pushed to the scan."""
    return polygons.filter((F.col("xmax") >= box[0]) & (F.col("xmin") <= box[2]) &
                           (F.col("ymax") >= box[1]) & (F.col("ymin") <= box[3]))


def class_cells(polygons: DataFrame, grid: GridSpec, fid: str, code: str | None = None) -> DataFrame:
    """Land-cover polygons as class cells; clipping is by cell centre."""
    name = class_column(polygons.columns, code)
    cells = burn_attribute(polygons, grid, fid, [name])
    return cells.select(*CELL, F.col(name).cast("string").alias("class"))


def class_raster(tiles: DataFrame, grid: GridSpec, code: str = "code", order: str = "tile", nodata: int = 0) -> DataFrame:
    """Tiles of class codes as one grid: no-data to null, cropped, first tile wins."""
    clean = tiles.filter(grid.inside()).withColumn(code, F.nullif(F.col(code), F.lit(nodata)))
    return mosaic(clean, code, order).select(*CELL, F.col(code).cast("string").alias("class"))


def survey_vintages(survey: DataFrame, first: int = SURVEY_WINDOW[0], last: int = SURVEY_WINDOW[1]) -> DataFrame:
    """Candidate vintages: survey polygons per department and flight year with their share of the area."""
    rows = survey.withColumn("year", F.year("date_vol")).filter(F.col("year").between(first, last))
    per = rows.groupBy("dep", "year").agg(
        F.max("pva").alias("pva"), F.min("date_vol").alias("date_vol"), F.count("*").alias("n_polygons"),
        F.sum("area").alias("area"))
    total = per.agg(F.sum("area")).scalar()
    pct = F.when(total > 0, F.bround(100.0 * F.col("area") / total, 1))
    return per.select("dep", "year", "pva", "date_vol", "n_polygons", pct.alias("pct_area")).orderBy("dep", "year")


def survey_vintage(survey: DataFrame, strategy: str = "oldest", first: int = SURVEY_WINDOW[0], last: int = SURVEY_WINDOW[1]) -> int:
    """One vintage for a forest source: the oldest candidate unless told otherwise."""
    pick = {"oldest": F.min, "newest": F.max}[strategy]
    year = survey_vintages(survey, first, last).agg(pick("year")).first()[0]
    if year is None:
        raise EmptyResult(f"no survey between {first} and {last}")
    return year


def vintage_per_department(candidates: DataFrame, strategy: str = "oldest") -> DataFrame:
    """The chosen candidate of every department."""
    order = F.asc("year") if strategy == "oldest" else F.desc("year")
    w = Window.partitionBy("dep").orderBy(order)
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def unknown_codes(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Codes no lookup row explains; they stay in the data as classes of their own."""
    known = lookup.select(F.col("code").alias("class"))
    return cells.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("cells")).join(
        known, "class", "left_anti")


def warn_unknown(cells: DataFrame, lookup: DataFrame) -> None:
    n = unknown_codes(cells, lookup).count()
    if n:
        notice(f"{n} class codes are not in the lookup; they are kept")
