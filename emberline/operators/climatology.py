"""Danger against its own climatology: reference filter, percentile ranks, thresholds."""

from __future__ import annotations

import math
import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.errors import BadPeriod, EmptyReference, notice
from emberline.functions.constants import DANGER_SEASON
from emberline.operators.rank import quantiles, share_at_or_below


def period_bounds(period) -> tuple[date, date]:
    """Two years or two dates as inclusive bounds."""
    if len(period) != 2:
        raise BadPeriod("a period has two ends")
    text = [str(p) for p in period]
    if all(re.fullmatch(r"\d{4}", t) for t in text):
        return date(int(text[0]), 1, 1), date(int(text[1]), 12, 31)
    try:
        lo, hi = (date.fromisoformat(t) for t in text)
    except ValueError as e:
        raise BadPeriod(f"cannot read {text} as years or dates") from e
    return lo, hi


def in_reference(day: str, period=None, season: tuple[str, str] | None = DANGER_SEASON) -> Column:
    """Whether a date lies in the period and in the month-day season, both ends included.

    A season may not wrap the new year.
    """
    keep = F.lit(True)
    if period is not None:
        lo, hi = period_bounds(period)
        keep = keep & F.col(day).between(F.lit(lo), F.lit(hi))
    if season is not None:
        if len(season) != 2 or not all(re.fullmatch(r"\d{2}-\d{2}", s) for s in season):
            raise BadPeriod("a season is two MM-DD strings")
        if season[0] > season[1]:
            raise BadPeriod("a season may not wrap the new year")
        keep = keep & F.date_format(day, "MM-dd").between(*season)
    return keep


def reference_report(series: DataFrame, day: str, period=None, season=DANGER_SEASON, min_ref: int = 365) -> DataFrame:
    """How much record stands behind a ranking: years, dates and the notices they call for."""
    years, dates = F.count_distinct(F.year(day)), F.count_distinct(day)
    return series.filter(in_reference(day, period, season)).agg(
        years.cast("int").alias("years"), dates.cast("int").alias("dates"),
        (years < 10).alias("short"), ((years >= 10) & (years < 30)).alias("below_normal"),
        (dates < min_ref).alias("thin"))


def check_reference(series: DataFrame, day: str, period=None, season=DANGER_SEASON, min_ref: int = 365) -> None:
    r = reference_report(series, day, period, season, min_ref).first()
    if r["dates"] == 0:
        raise EmptyReference("no record falls inside the reference period and season")
    if r["short"]:
        notice(f"the reference spans {r['years']} years; the standard normal is 30")
    if r["thin"]:
        notice(f"only {r['dates']} reference dates")


def percentile_of_series(series: DataFrame, value: str, day: str, cell: list[str], period=None, season=DANGER_SEASON,
                         out: str = "percentile") -> DataFrame:
    """Rank of each day in the reference record of its own cell, 0 to 100.

    One shuffle by cell, then one window.  A cell has a row a day, so its record is as long as the archive in days
    whatever the size of the grid; records pooled over cells go to :func:`percentile_of_zone`.
    """
    df = series.withColumn("_ref", in_reference(day, period, season) & F.col(value).isNotNull())
    w = Window.partitionBy(*cell)
    upto = w.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ref = F.col("_ref").cast("int")
    total = F.sum(ref).over(w)
    share = F.when(F.col(value).isNotNull() & (total > 0), 100.0 * F.sum(ref).over(upto) / total)
    return df.withColumn(out, share).drop("_ref")


def percentile_of_zone(series: DataFrame, value: str, day: str, zone: str, period=None, season=DANGER_SEASON,
                       out: str = "percentile") -> DataFrame:
    """Rank of each value in the pooled reference record of its zone; zones may be of any size."""
    df = series.withColumn("_ref", in_reference(day, period, season) & F.col(value).isNotNull())
    known = df.filter(F.col(zone).isNotNull())
    ranked = share_at_or_below(known, value, "_ref", [zone], out)
    outside = df.filter(F.col(zone).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(outside).drop("_ref")


def thin_zones(series: DataFrame, value: str, day: str, zone: str, period=None, season=DANGER_SEASON,
               min_ref: int = 365) -> DataFrame:
    """Zones whose pooled reference holds fewer values than the floor."""
    pool = series.filter(in_reference(day, period, season) & F.col(zone).isNotNull())
    return pool.groupBy(zone).agg(F.count(value).alias("n_ref")).filter(F.col("n_ref") < min_ref)


def class_thresholds(series: DataFrame, value: str, day: str, ndays: int = 4, season=DANGER_SEASON) -> DataFrame:
    """Five danger breaks from the climatology of extremes.

    Per-year season quantile pooled over cells, its median across years as the
    extreme E, then fire intensity steps between 1 and the intensity at E.  The
    intensity equation log(0.289 i) = 0.980 log(E)^1.546 is solved directly.
    """
    p = math.floor((1 - ndays / 365) * 100) / 100
    kept = series.filter(in_reference(day, None, season)).select(F.year(day).alias("year"), F.col(value).cast("double").alias("v"))
    yearly = quantiles(kept, "v", [p], ["year"])
    e = yearly.agg(F.median("q").alias("extreme"), F.count("*").cast("int").alias("n_years"))
    log_e = F.log("extreme")
    i = F.when((F.col("extreme") > 0) & (log_e >= 0), F.exp(0.980 * F.pow(log_e, F.lit(1.546))) / 0.289)
    root = F.when(i.between(0.1, 1e14), i)

    def step(k: int) -> Column:
        inner = F.log(0.289 * F.pow(F.col("i"), F.lit(k / 5)))
        v = F.when(inner >= 0, F.bround(F.exp(1.013 * F.pow(inner, F.lit(0.647)))))
        return F.when(F.col("i").isNotNull(), F.coalesce(v, F.lit(0.0))).alias(f"t{k}")

    return e.withColumn("i", root).select("extreme", "n_years", F.lit(p).alias("percentile"), *[step(k) for k in range(1, 6)])
