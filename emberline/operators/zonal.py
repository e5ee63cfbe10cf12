"""Topographic zones, their tables, and weather brought down to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.errors import AllNull, BadRange, BadWeather, UnknownName, notice
from emberline.functions.scalars import rh_at_temperature
from emberline.grid import CELL, GridSpec
from emberline.operators.classify import right_closed_band
from emberline.operators.fwi import check_columns, fwi_series
from emberline.operators.proximity import nearest
from emberline.operators.rank import quantiles


def elevation_breaks(cells: DataFrame, dem: str, n_elev: int) -> list[float]:
    """Quantile breaks of the elevation, duplicates dropped; a handful of numbers."""
    probs = [i / n_elev for i in range(n_elev + 1)]
    got = sorted({r["q"] for r in quantiles(cells.select(F.col(dem).cast("double").alias(dem)), dem, probs).collect()})
    if not got:
        raise AllNull("the elevation model is entirely null")
    return got if len(got) > 1 else [got[0] - 1, got[0] + 1]


def topo_zones(cells: DataFrame, dem: str, n_elev: int = 8, n_aspect: int = 1, aspect: str | None = None,
               station_no: str | None = None) -> DataFrame:
    """Zone number of each cell: elevation band, crossed with aspect class and nearest station.

    Bands are (lo, hi] with the lowest value included.  Level ground counts as the
    first aspect class.  ``station_no`` numbers the stations from 1.
    """
    if n_elev < 1 or n_aspect < 1:
        raise BadRange("n_elev and n_aspect must be at least 1")
    band = right_closed_band(dem, elevation_breaks(cells, dem, n_elev))
    zone = band
    if n_aspect > 1:
        width = 360.0 / n_aspect
        turned = F.pmod(F.col(aspect) + width / 2, F.lit(360.0))
        zone = (band - 1) * n_aspect + F.coalesce(F.floor(turned / width) + 1, F.lit(1))
    if station_no is not None:
        zone = (F.col(station_no) - 1) * (n_elev * n_aspect) + zone
    return cells.withColumn("zone", zone.cast("int"))


def zone_table(zones: DataFrame, grid: GridSpec, dem: str, lat: Column | None = None, station: str | None = None) -> DataFrame:
    """One row per zone: cells, elevation summary, median latitude and centroid."""
    lat = grid.y("row") if lat is None else lat
    rows = zones.filter(F.col("zone").isNotNull() & F.col(dem).isNotNull()).withColumns(
        {"_lat": lat, "_x": grid.x("col"), "_y": grid.y("row")})
    extra = [F.min(station).alias("station")] if station else []
    # one pass over the cells: latitudes are as few as grid rows, so a zone's median follows from its partial rows
    part = rows.groupBy("zone", "_lat").agg(
        F.count("*").alias("n"), F.sum(dem).alias("se"), F.min(dem).alias("lo"), F.max(dem).alias("hi"),
        F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), *extra)
    n = F.sum("n")
    return part.groupBy("zone").agg(
        n.alias("n_cells"), (F.sum("se") / n).alias("elev_mean"), F.min("lo").alias("elev_min"), F.max("hi").alias("elev_max"),
        (F.sum("sx") / n).alias("x"), (F.sum("sy") / n).alias("y"), *extra,
        F.percentile(F.col("_lat").cast("double"), F.lit(0.5), F.col("n")).alias("lat"))


def wind_weight(zones: DataFrame, curvature: str, weight: float = 0.5) -> DataFrame:
    """Wind multiplier of each zone from its mean curvature; 1 where there is none."""
    if not 0 <= weight <= 1:
        raise BadRange("curve weight must lie in [0, 1]")
    return zones.filter(F.col("zone").isNotNull()).groupBy("zone").agg(
        (1 + F.lit(float(weight)) * F.coalesce(F.avg(curvature), F.lit(0.0))).alias("wind_weight"))


def _t_two_sided(t: float, df: int) -> float:
    """Two-sided p-value of Student's t through the incomplete beta continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def fraction(a, b, x):
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def rain_fit(weather: DataFrame) -> DataFrame:
    """Regression of mean station rain on elevation, as one row of statistics."""
    means = weather.filter(F.col("prec").isNotNull() & F.col("elev_m").isNotNull()).groupBy("id", "elev_m").agg(
        F.avg("prec").alias("prec"))
    return means.agg(
        F.count("*").cast("int").alias("n_points"), F.regr_slope("prec", "elev_m").alias("slope"),
        F.regr_r2("prec", "elev_m").alias("r_squared"), F.avg("prec").alias("mean_prec"),
        (F.max("elev_m") - F.min("elev_m")).cast("double").alias("elev_range_m"))


def rain_gradient(weather: DataFrame, p_max: float = 0.05) -> dict:
    """The fit with its p-value and whether it may be used to correct rain."""
    r = rain_fit(weather).first().asDict()
    r.update(relative=None, p_value=None, usable=False)
    if r["n_points"] < 3 or not r["elev_range_m"]:
        return {**r, "slope": None, "r_squared": None}
    r["relative"] = 1000 * r["slope"] / r["mean_prec"] if r["mean_prec"] else None
    r2, df = r["r_squared"], r["n_points"] - 2
    if r2 is not None:
        r["p_value"] = 0.0 if r2 >= 1 else _t_two_sided(math.sqrt(r2 * df / (1 - r2)), df)
        r["usable"] = r["p_value"] <= p_max
    return r


def downscale(weather: DataFrame, zones: DataFrame, lapse_rate: float = 6.5, wind: DataFrame | None = None,
              rain_slope: float | None = None) -> DataFrame:
    """Station-days moved to the zones: lapse-rate temperature, constant dew point, optional wind and rain.

    ``zones`` carries ``zone, station, elev_mean, lat``; ``wind`` the multiplier of each zone.
    """
    w = check_columns(weather, ["id", "lat", "yr", "mon", "day", "temp", "rh", "ws", "prec"])
    if "elev_m" not in w.columns:
        raise BadWeather("weather has no elev_m: there is nothing to correct from")
    z = zones.select("zone", F.col("station").alias("id"), F.col("elev_mean"), F.col("lat").alias("zone_lat"))
    if wind is not None:
        z = z.join(wind.select("zone", "wind_weight"), "zone", "left").fillna(1.0, ["wind_weight"])
    else:
        z = z.withColumn("wind_weight", F.lit(1.0))
    both = w.join(z, "id")
    dz = F.col("elev_mean") - F.col("elev_m")
    t_new = F.col("temp") - F.lit(float(lapse_rate)) * dz / 1000
    rain = F.col("prec")
    if rain_slope is not None:
        rain = F.when(rain.isNotNull() & dz.isNotNull(), F.greatest(rain + F.lit(float(rain_slope)) * dz, F.lit(0.0)))
    keep = [c for c in ("long",) if c in w.columns]
    return both.select(
        "zone", F.col("zone_lat").alias("lat"), *keep, "yr", "mon", "day", t_new.alias("temp"),
        rh_at_temperature("temp", "rh", t_new).alias("rh"), (F.col("ws") * F.col("wind_weight")).alias("ws"),
        rain.alias("prec"), F.col("elev_mean").alias("elev_m"), F.col("id").alias("from_id"))


def downscale_auto(weather: DataFrame, zones: DataFrame, stations: DataFrame, grid: GridSpec, **kw) -> DataFrame:
    """As :func:`downscale`, giving zones without a station the one nearest their centroid."""
    if "station" not in zones.columns:
        notice("zones were built without stations; each takes the station nearest its centroid")
        zones = nearest(zones, stations)
    return downscale(weather, zones, **kw)


def zonal_fwi(weather: DataFrame, index: str = "fwi", dates: list | None = None, **kw) -> DataFrame:
    """Recurrence per zone, then only the wanted days: (zone, date, value)."""
    days = fwi_series(weather, ["zone"], out=[index], **kw).select(
        "zone", F.make_date("yr", "mon", "day").alias("date"), F.col(index).alias("value"))
    if dates is None:
        return days
    have = {r[0] for r in weather.select(F.make_date("yr", "mon", "day").alias("d")).filter(
        F.col("d").isin(list(dates))).distinct().collect()}
    lacking = [d for d in dates if d not in have]
    if lacking:
        raise UnknownName(f"dates not in the weather: {lacking[:3]}")
    return days.filter(F.col("date").isin(list(dates)))


def paint(zones: DataFrame, values: DataFrame) -> DataFrame:
    """Zone values back on the grid, one row per cell and date."""
    return zones.select(*CELL, "zone").join(values, "zone").select("date", *CELL, "zone", "value")
