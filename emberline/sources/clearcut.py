"""Clear-cut detections: decode, filter and keep out of fire perimeters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import BadRange, notice
from emberline.grid import CELL, GridSpec


def decode_cuts(cells: DataFrame, code: str = "code") -> DataFrame:
    """Year and day of year from YYDDD; 0 means no detection."""
    known = F.nullif(F.col(code), F.lit(0))
    return cells.withColumn("_c", known).withColumns({
        "cut_year": F.expr("cast(2000 + _c div 1000 as int)"), "cut_doy": F.pmod("_c", F.lit(1000)).cast("int"),
    }).drop("_c")


def clear_cuts(cells: DataFrame, code: str = "code", prob: str | None = None, min_prob: float | None = None,
               years: list[int] | None = None, burnt: DataFrame | None = None) -> DataFrame:
    """Detections above a probability, of some years, outside fires."""
    if min_prob is not None and not 0 <= min_prob <= 100:
        raise BadRange("min_prob is a percentage")
    out = decode_cuts(cells, code).filter(F.col("cut_year").isNotNull())
    if min_prob is not None:
        out = out.filter(F.col(prob) >= min_prob)
    if years is not None:
        out = out.filter(F.col("cut_year").isin(*years))
    if burnt is None:
        notice("no fire perimeters given: burnt areas count as clear-cuts")
        return out
    return out.join(burnt.select(*CELL).distinct(), CELL, "left_anti")


def cut_report(cuts: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells and hectares cut per year."""
    return cuts.groupBy("cut_year").agg(F.count("*").alias("cells")).withColumn("area_ha", F.col("cells") * F.lit(grid.cell_ha))
