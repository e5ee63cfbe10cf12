"""Burnt areas: preparation, period filter with coverage report, fire span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import EmptyResult, notice
from emberline.functions.scalars import flex_date
from emberline.operators.raster import ring_area


def prepare_burnt(raw: DataFrame, rings: str = "rings") -> DataFrame:
    """Typed fires: date in either format, year, hectares from the attribute or the outline."""
    by_lower = {c.lower(): c for c in raw.columns}
    if "firedate" not in by_lower:
        raise EmptyResult("burnt areas carry no FIREDATE column")
    date = flex_date(by_lower["firedate"])
    area = F.expr(f"try_cast(`{by_lower['area_ha']}` AS DOUBLE)") if "area_ha" in by_lower else F.lit(None).cast("double")
    if rings in raw.columns:
        area = F.coalesce(area, ring_area(F.col(rings)) / 1e4)
    keep = [c for k, c in by_lower.items() if k not in ("fire_date", "fire_year", "area_ha")]
    return raw.select(*keep, date.alias("fire_date"), F.year(date).alias("fire_year"), area.alias("area_ha"))


def burnt_in_period(fires: DataFrame, first: int, last: int) -> DataFrame:
    """Fires of a span of years; a fire without a year cannot be placed and is dropped."""
    return fires.filter(F.col("fire_year").between(first, last))


def period_report(fires: DataFrame, first: int, last: int) -> DataFrame:
    """What was asked against what the data covers, and what the filter keeps."""
    inside = F.col("fire_year").between(first, last)
    return fires.agg(
        F.lit(first).alias("asked_first"), F.lit(last).alias("asked_last"),
        F.min("fire_year").alias("have_first"), F.max("fire_year").alias("have_last"),
        F.count_if(inside).alias("n_fires"),
        F.coalesce(F.sum(F.when(inside, F.col("area_ha"))), F.lit(0.0)).alias("area_ha"),
        ((F.min("fire_year") > first) | (F.max("fire_year") < last)).alias("truncated"))


def fire_span(fires: DataFrame) -> DataFrame:
    """First and last day of a fire or group of fires; a missing or earlier end falls back to the start."""
    start, end = F.min(flex_date("FIREDATE")), F.max(flex_date("FINALDATE"))
    return fires.agg(start.alias("fire_start"), F.when(end >= start, end).otherwise(start).alias("fire_end"))


def load_burnt(raw: DataFrame, period: tuple[int, int] | None = None) -> DataFrame:
    fires = prepare_burnt(raw)
    if period is None:
        return fires
    r = period_report(fires, *period).first()
    if r["truncated"]:
        notice(f"asked for {period[0]}-{period[1]}, the data covers {r['have_first']}-{r['have_last']}")
    return burnt_in_period(fires, *period)
