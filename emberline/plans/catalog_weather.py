"""Queries of the weather, fire-danger, climatology and zonal operators, streams included."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.grid import CELL
from emberline.operators import climatology, fwi, raster, terrain, zonal
from emberline.operators.proximity import nearest
from emberline.plans.catalog_grid import _HORN
from emberline.plans.inputs import Inputs, rd, sql
from emberline.plans.registry import query
from emberline.session import cut_lineage, scratch_path
from emberline.sources import weather as src
from emberline.streaming import weather_stream


# Published day-length factors by month, January first; fixed values, stated apart from the operator's own.
_DAY_NORTH = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
_DAY_NORTH_LOW = (7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8)
_DAY_SOUTH_LOW = (10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2)
_DAY_SOUTH = (11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10.0, 11.2, 11.8)
_DRY_NORTH = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
_DRY_SOUTH = (6.4, 5.0, 2.4, 0.4, -1.6, -1.6, -1.6, -1.6, -1.6, 0.9, 3.8, 5.8)


def _band(cases: list[tuple[str, tuple]], last: tuple) -> str:
    arms = " ".join(f"WHEN {c} THEN [{', '.join(map(str, v))}]" for c, v in cases)
    return f"(CASE {arms} ELSE [{', '.join(map(str, last))}] END)[mon]"


def _recurrence(src_cte: str, key: str, ordinal: str | None = None, mean: bool = False) -> str:
    """The moisture codes as a recursive query over ordinal days, per key or carried as means."""
    le = _band([("lat >= 30", _DAY_NORTH), ("lat >= 10", _DAY_NORTH_LOW), ("lat >= -10", (9.0,) * 12), ("lat >= -30", _DAY_SOUTH_LOW)], _DAY_SOUTH)
    lf = _band([("lat > 20", _DRY_NORTH), ("lat >= -20", (1.4,) * 12)], _DRY_SOUTH)
    ordinal = ordinal or f"row_number() OVER (PARTITION BY {key} ORDER BY d)"
    carry, close = ("SELECT key, k, avg(f), avg(p), avg(c) FROM (", ") GROUP BY key, k") if mean else ("", "")
    return f"""
w0 AS MATERIALIZED (SELECT *, {key} AS key, {ordinal} AS k, {le}::DOUBLE AS le, {lf}::DOUBLE AS lf,
  least(rh, 99.9999) AS h FROM {src_cte}),
rec AS (
  SELECT DISTINCT key, 0::BIGINT AS k, 85::DOUBLE AS f, 6::DOUBLE AS p, 15::DOUBLE AS c FROM w0
  UNION ALL
  {carry}SELECT key, k, least(greatest(59.5 * (250 - m) / (147.2 + m), 0), 101) AS f,
    greatest(0, CASE WHEN prec > 1.5 THEN greatest(0, 43.43 * (5.6348 - ln(greatest(mr - 20, 1e-9)))) ELSE p END
      + 1.894 * (greatest(temp, -1.1) + 1.1) * (100 - h) * le * 1e-4) AS p,
    greatest(0, CASE WHEN prec > 2.8 THEN greatest(0, c - 400 * ln(1 + 3.937 * greatest(0.83 * prec - 1.27, 0) / (800 * exp(-c / 400)))) ELSE c END
      + greatest(0, (0.36 * (greatest(temp, -2.8) + 2.8) + lf) / 2)) AS c
  FROM (SELECT *, CASE
      WHEN mo > ed THEN ed + (mo - ed) * pow(10, -(0.424 * (1 - pow(h / 100, 1.7)) + 0.0694 * sqrt(ws) * (1 - pow(h / 100, 8))) * 0.581 * exp(0.0365 * temp))
      WHEN mo < ew THEN ew - (ew - mo) * pow(10, -(0.424 * (1 - pow((100 - h) / 100, 1.7)) + 0.0694 * sqrt(ws) * (1 - pow((100 - h) / 100, 8))) * 0.581 * exp(0.0365 * temp))
      ELSE mo END AS m,
      20 + exp(5.6348 - p / 43.43) + 1000 * (0.92 * prec - 1.27) / (48.77 + (0.92 * prec - 1.27) * CASE WHEN p <= 33 THEN 100 / (0.5 + 0.3 * p)
        WHEN p <= 65 THEN 14 - 1.3 * ln(greatest(p, 1e-9)) ELSE 6.2 * ln(greatest(p, 1e-9)) - 17.2 END) AS mr
    FROM (SELECT *, CASE WHEN prec > 0.5 THEN least(250, mo0 + 42.5 * rf * exp(-100 / (251 - mo0)) * (1 - exp(-6.93 / rf))
            + CASE WHEN mo0 > 150 THEN 0.0015 * pow(mo0 - 150, 2) * sqrt(rf) ELSE 0 END) ELSE mo0 END AS mo,
          0.942 * pow(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * h)) AS ed,
          0.618 * pow(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * h)) AS ew
        FROM (SELECT w0.key, w0.k, temp, h, ws, prec, le, lf, f, p, c, 147.2 * (101 - f) / (59.5 + f) AS mo0, greatest(prec - 0.5, 1e-12) AS rf
              FROM rec JOIN w0 ON w0.key = rec.key AND w0.k = rec.k + 1))){close}),
codes AS (
  SELECT w0.*, f AS ffmc, p AS dmc, c AS dc, isi, bui, CASE WHEN b > 1 THEN exp(2.72 * pow(0.434 * ln(b), 0.647)) ELSE b END AS fwi FROM (
    SELECT *, 0.1 * isi * CASE WHEN bui <= 80 THEN 0.626 * pow(bui, 0.809) + 2 ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END AS b FROM (
      SELECT *, 0.208 * exp(0.05039 * ws) * 91.9 * exp(-0.1386 * fm) * (1 + pow(fm, 5.31) / 4.93e7) AS isi,
        CASE WHEN u < p THEN greatest(0, p - (0.92 + pow(0.0114 * p, 1.7)) * CASE WHEN p = 0 THEN 0 ELSE (p - u) / p END) ELSE u END AS bui FROM (
        SELECT rec.key, rec.k, f, p, c, ws, 147.2 * (101 - f) / (59.5 + f) AS fm, CASE WHEN p + 0.4 * c = 0 THEN 0 ELSE 0.8 * c * p / (p + 0.4 * c) END AS u
        FROM rec JOIN w0 ON w0.key = rec.key AND w0.k = rec.k))) x JOIN w0 ON w0.key = x.key AND w0.k = x.k)"""


def _seven(digits: int = 4) -> str:
    cols = ["ffmc", "dmc", "dc", "isi", "bui", "fwi"]
    return ", ".join(f"{rd(c, digits)} AS {c}" for c in cols) + f", {rd('0.0272 * pow(fwi, 1.77)', digits)} AS dsr"


def _short(df: DataFrame, cols: list[str]) -> DataFrame:
    """Four decimals for outputs of long recurrences, whose last digits are platform noise."""
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query("fwi_series", "D01", sql(f"SELECT id, d AS date, {_seven()} FROM codes", _recurrence("weather", "id")))
def fwi_series(i: Inputs) -> DataFrame:
    return _short(fwi.fwi_series(i.weather(), ["id"]).select("id", "date", *fwi.CODES), fwi.CODES)


_MEAN = """h1 AS (SELECT id, CAST(ts AS DATE) AS d, temp, rh, ws, (SELECT coalesce(sum(p.prec), 0) FROM hourly p WHERE p.id = n.id AND p.ts BETWEEN n.ts - INTERVAL 23 HOUR AND n.ts) AS prec
  FROM hourly n WHERE hour(ts) = 12),
hd AS (SELECT *, CAST(month(d) AS INTEGER) AS mon, dense_rank() OVER (ORDER BY d) AS n, 43.0 AS lat FROM h1),
every AS (SELECT n AS id, max(d) AS d FROM hd GROUP BY n)"""


@query("fwi_spatial_mean", "D03", sql(
    f"SELECT d AS date, {rd('f')} AS ffmc, {rd('p')} AS dmc, {rd('c')} AS dc FROM rec JOIN every ON every.id = rec.k", _MEAN, _recurrence("hd", "1", "n", mean=True)))
def fwi_spatial_mean(i: Inputs) -> DataFrame:
    days = src.daily_from_hourly(i.hourly(), 12).withColumn("lat", F.lit(43.0))
    dates = [r[0] for r in days.select("date").distinct().collect()]
    got = fwi.fwi_by_spatial_mean(days, dates)
    return got.groupBy("date").agg(*[F.avg(c).alias(c) for c in ("ffmc", "dmc", "dc")])


@query("fwi_annual_grid", "D02 A22 J15", sql(
    f"""SELECT d AS date, CAST(40 - 1 - dense_rank() OVER (ORDER BY lat) + 1 AS INTEGER) AS "row", CAST(long / 2.5 AS INTEGER) AS "col", {rd('fwi', 4)} AS value FROM codes""",
    _recurrence("weather", "id * 10000 + yr - CAST(mon < 3 AS INTEGER)")).replace("40 - 1 - dense_rank() OVER (ORDER BY lat) + 1", "(SELECT count(DISTINCT lat) FROM weather) - dense_rank() OVER (ORDER BY lat)"))
def fwi_annual_grid(i: Inputs) -> DataFrame:
    days = fwi.fwi_series(i.weather(), ["id"], reset="annual", reset_month=3, out=["fwi"])
    return _short(fwi.assemble(days, "fwi", stations=i.lattice()), ["value"])


@query("season_key", "A22", sql(
    "SELECT CAST(yr - CAST(mon < 10 AS INTEGER) AS INTEGER) AS season, count(*) AS days, count(DISTINCT id) AS stations FROM weather GROUP BY 1"))
def season_key(i: Inputs) -> DataFrame:
    return i.weather().groupBy(fwi.season_key(10).cast("int").alias("season")).agg(F.count("*").alias("days"), F.count_distinct("id").alias("stations"))


@query("weather_range_report", "M01", sql(
    """SELECT count(*) AS n, count(*) FILTER (rh < 0 OR rh > 100) AS bad_rh, count(*) FILTER (ws < 0 OR prec < 0) AS negative,
         count(*) FILTER (abs(temp) > 60) AS odd_temp, max(ws) AS max_ws, max(ws) < 30 AND count(*) >= 30 AS wind_unit_suspect FROM weather"""))
def weather_range_report(i: Inputs) -> DataFrame:
    return fwi.range_report(i.weather())


@query("axis_positions", "J15", sql(
    """SELECT CAST(lat AS DOUBLE) AS lat, CAST(dense_rank() OVER (ORDER BY lat DESC) - 1 AS INTEGER) AS "row" FROM (SELECT DISTINCT lat FROM weather)"""))
def axis_positions(i: Inputs) -> DataFrame:
    return fwi.axis_index(i.lattice(), "lat", "row", descending=True)


_REF = "d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND strftime(d, '%m-%d') BETWEEN '04-01' AND '10-31'"
_PERIOD = (1996, 1999)


@query("percentile_by_cell", "W01 M19", sql(
    f"""SELECT id, d AS date, {rd('CASE WHEN value IS NOT NULL AND t > 0 THEN 100.0 * k / t END')} AS percentile FROM (
        SELECT *, sum(ref) OVER (PARTITION BY id ORDER BY value NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, sum(ref) OVER (PARTITION BY id) AS t
        FROM (SELECT *, CAST({_REF} AND value IS NOT NULL AS INTEGER) AS ref FROM series))"""))
def percentile_by_cell(i: Inputs) -> DataFrame:
    return climatology.percentile_of_series(i.series(), "value", "date", ["id"], _PERIOD).select("id", "date", "percentile")


_BYZONE = f"""SELECT id, d AS date, {rd('CASE WHEN value IS NOT NULL AND zone IS NOT NULL AND t > 0 THEN 100.0 * k / t END')} AS percentile FROM (
        SELECT *, sum(ref) OVER (PARTITION BY zone ORDER BY value NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, sum(ref) OVER (PARTITION BY zone) AS t
        FROM (SELECT *, CAST({_REF} AND value IS NOT NULL AS INTEGER) AS ref FROM series))"""


@query("percentile_by_zone", "W02", sql(_BYZONE))
def percentile_by_zone(i: Inputs) -> DataFrame:
    return climatology.percentile_of_zone(i.series(), "value", "date", "zone", _PERIOD).select("id", "date", "percentile")


@query("thin_zones", "W02 A20", sql(
    f"SELECT zone, count(value) AS n_ref FROM series WHERE zone IS NOT NULL AND {_REF} GROUP BY zone HAVING count(value) < 1000"))
def thin_zones(i: Inputs) -> DataFrame:
    return climatology.thin_zones(i.series(), "value", "date", "zone", _PERIOD, min_ref=1000)


@query("reference_report", "A20 M19", sql(
    f"""SELECT CAST(count(DISTINCT year(d)) AS INTEGER) AS years, CAST(count(DISTINCT d) AS INTEGER) AS dates, count(DISTINCT year(d)) < 10 AS short,
          count(DISTINCT year(d)) BETWEEN 10 AND 29 AS below_normal, count(DISTINCT d) < 365 AS thin FROM series WHERE {_REF}"""))
def reference_report(i: Inputs) -> DataFrame:
    return climatology.reference_report(i.series(), "date", _PERIOD)


@query("danger_series_window", "S19 M19", sql(
    f"SELECT id, d AS date, {rd('value')} AS value FROM series WHERE {_REF}"))
def danger_series_window(i: Inputs) -> DataFrame:
    return i.series().filter(climatology.in_reference("date", ("1996-01-01", "1999-12-31"))).select("id", "date", "value")


@query("class_thresholds", "A18", sql(
    f"""SELECT {rd('e')} AS extreme, n_years, CAST(0.98 AS DOUBLE) AS percentile, {', '.join(f'coalesce(round_even(exp(1.013 * pow(CASE WHEN ln(0.289 * pow(i, {k / 5})) >= 0 THEN ln(0.289 * pow(i, {k / 5})) END, 0.647)), 0), 0.0) AS t{k}' for k in range(1, 6))}
        FROM (SELECT *, exp(0.980 * pow(ln(e), 1.546)) / 0.289 AS i FROM (SELECT median(q) AS e, CAST(count(*) AS INTEGER) AS n_years FROM (
          SELECT year(d) AS y, quantile_cont(value, 0.98) AS q FROM series WHERE strftime(d, '%m-%d') BETWEEN '04-01' AND '10-31' GROUP BY 1)))"""))
def class_thresholds(i: Inputs) -> DataFrame:
    return climatology.class_thresholds(i.series(), "value", "date")


@query("hourly_to_daily", "S03", sql(
    f"""SELECT id, CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS yr, CAST(month(d) AS INTEGER) AS mon, CAST(day(d) AS INTEGER) AS day, {rd('temp')} AS temp, rh, ws,
          {rd('(SELECT coalesce(sum(p.prec), 0) FROM hourly p WHERE p.id = n.id AND p.ts BETWEEN n.ts - INTERVAL 23 HOUR AND n.ts)')} AS prec
        FROM (SELECT *, CAST(ts AS DATE) AS d FROM hourly WHERE hour(ts) = 12) n WHERE d >= DATE '2024-01-02'"""))
def hourly_to_daily(i: Inputs) -> DataFrame:
    return src.daily_from_hourly(i.hourly(), 12, "2024-01-02")


@query("served_elevation", "S05 U01", sql(
    f"""SELECT id, CAST(ts AS DATE) AS date, {rd('temp')} AS temp, CASE WHEN id IN (SELECT id FROM stations) THEN CAST(100 + id * 37 % 900 AS DOUBLE) END AS elev_m FROM hourly WHERE hour(ts) IN (6, 12)"""))
def served_elevation(i: Inputs) -> DataFrame:
    served = i.stations().select("id", "elev_m")
    days = src.union_chunks(src.daily_from_hourly(i.hourly(), 6), src.daily_from_hourly(i.hourly(), 12))
    return src.with_served(days, served).select("id", "date", "temp", "elev_m")


@query("nearest_station", "J09", sql(
    f"""SELECT r AS "row", c AS "col", arg_min(id, struct_pack(a := d2, b := id)) AS station, {rd('min(d2)')} AS d2 FROM (
        SELECT r, c, id, ((c + 0.5) * 25 - x) * ((c + 0.5) * 25 - x) + ((w - r - 0.5) * 25 - y) * ((w - r - 0.5) * 25 - y) AS d2 FROM cells CROSS JOIN stations) GROUP BY r, c"""))
def nearest_station(i: Inputs) -> DataFrame:
    pts = i.cells().select(*CELL, i.grid.x().alias("x"), i.grid.y().alias("y"))
    return nearest(pts, i.stations()).select(*CELL, "station", "d2")


def _zones(i: Inputs) -> DataFrame:
    """Four elevation bands crossed with the nearest station's territory."""
    pts = i.cells().select(*CELL, "elev", i.grid.x().alias("x"), i.grid.y().alias("y"))
    near = nearest(pts, i.stations()).withColumn("no", F.col("station") + 1)
    return zonal.topo_zones(near, "elev", n_elev=4, station_no="no")


_ZONES = """brk AS (SELECT quantile_cont(elev, 0.0) AS b0, quantile_cont(elev, 0.25) AS b1, quantile_cont(elev, 0.5) AS b2, quantile_cont(elev, 0.75) AS b3 FROM cells),
nst AS (SELECT r, c, arg_min(id, struct_pack(a := d2, b := id)) AS station FROM (
  SELECT r, c, id, ((c + 0.5) * 25 - x) * ((c + 0.5) * 25 - x) + ((w - r - 0.5) * 25 - y) * ((w - r - 0.5) * 25 - y) AS d2 FROM cells CROSS JOIN stations) GROUP BY r, c),
zones AS (SELECT cells.r, cells.c, elev, w, station, CAST(station * 4 + CASE WHEN elev <= b1 THEN 1 WHEN elev <= b2 THEN 2 WHEN elev <= b3 THEN 3 ELSE 4 END AS INTEGER) AS zone
  FROM cells JOIN nst USING (r, c), brk),
ztab AS (SELECT zone, count(*) AS n_cells, avg(elev) AS elev_mean, min(elev) AS elev_min, max(elev) AS elev_max, avg((c + 0.5) * 25) AS x,
  avg((w - r - 0.5) * 25) AS y, min(station) AS station, median((w - r - 0.5) * 25) AS lat FROM zones GROUP BY zone)"""


@query("topo_zones", "A04", sql('SELECT r AS "row", c AS "col", zone FROM zones', _ZONES))
def topo_zones(i: Inputs) -> DataFrame:
    return _zones(i).select(*CELL, "zone")


@query("topo_aspect_zones", "A04 N09", sql(
    """SELECT r AS "row", c AS "col", CAST((CASE WHEN elev <= b1 THEN 1 WHEN elev <= b2 THEN 2 WHEN elev <= b3 THEN 3 ELSE 4 END - 1) * 4
         + coalesce(floor(((aspect + 45) % 360) / 90) + 1, 1) AS INTEGER) AS zone FROM cells JOIN terr USING (r, c), brk""",
    "brk AS (SELECT quantile_cont(elev, 0.25) AS b1, quantile_cont(elev, 0.5) AS b2, quantile_cont(elev, 0.75) AS b3 FROM cells)",
    _HORN))
def topo_aspect_zones(i: Inputs) -> DataFrame:
    faced = terrain.slope_aspect(i.cells(), i.grid, "elev")
    return zonal.topo_zones(faced, "elev", 4, 4, "aspect").select(*CELL, "zone")


@query("zone_table", "A05", sql(
    f"""SELECT zone, n_cells, {rd('elev_mean')} AS elev_mean, elev_min, elev_max, {rd('x')} AS x, {rd('y')} AS y, station, {rd('lat')} AS lat FROM ztab""", _ZONES))
def zone_table(i: Inputs) -> DataFrame:
    return zonal.zone_table(_zones(i), i.grid, "elev", station="station")


_CURVE = """z AS (SELECT r, c, elev AS z FROM cells),
nb AS (SELECT t.r, t.c, t.z, sum(s.z) AS s, count(s.z) AS n FROM z t
  CROSS JOIN (SELECT dy, dx FROM (VALUES (-4), (0), (4)) a(dy), (VALUES (-4), (0), (4)) b(dx) WHERE dy <> 0 OR dx <> 0)
  LEFT JOIN z s ON s.r = t.r + dy AND s.c = t.c + dx GROUP BY t.r, t.c, t.z),
curve AS (SELECT r, c, k / (2 * greatest(max(abs(k)) OVER (), 0.001)) AS curvature FROM (SELECT r, c, CASE WHEN n = 8 THEN (z - s / 8) / 200.0 END AS k FROM nb)),
wwt AS (SELECT zone, 1 + 0.5 * coalesce(avg(curvature), 0) AS wind_weight FROM zones JOIN curve USING (r, c) GROUP BY zone)"""


def _wind(i: Inputs, zones: DataFrame) -> DataFrame:
    curve = terrain.curvature(i.cells(), i.grid, "elev", 100).select(*CELL, "curvature")
    return zonal.wind_weight(zones.join(curve, CELL), "curvature", 0.5)


@query("zone_wind_weight", "A06", sql(f"SELECT zone, {rd('wind_weight')} AS wind_weight FROM wwt", _ZONES, _CURVE))
def zone_wind_weight(i: Inputs) -> DataFrame:
    return _wind(i, _zones(i))


@query("rain_gradient", "A07", sql(
    f"""SELECT CAST(count(*) AS INTEGER) AS n_points, {rd('regr_slope(p, elev_m)')} AS slope, {rd('regr_r2(p, elev_m)')} AS r_squared, {rd('avg(p)')} AS mean_prec,
          CAST(max(elev_m) - min(elev_m) AS DOUBLE) AS elev_range_m FROM (SELECT id, elev_m, avg(prec) AS p FROM weather GROUP BY id, elev_m)"""))
def rain_gradient(i: Inputs) -> DataFrame:
    return zonal.rain_fit(i.weather())


_DOWN = """dw AS (SELECT z.zone, z.lat / 1000.0 AS lat, yr, mon, day, d, temp - 6.5 * (elev_mean - elev_m) / 1000 AS temp, temp AS t0, rh AS rh0, ws * wind_weight AS ws,
    greatest(prec + 0.001 * (elev_mean - elev_m), 0) AS prec FROM weather JOIN ztab z ON z.station = weather.id JOIN wwt USING (zone)),
down AS (SELECT zone, lat, yr, mon, day, d, temp, ws, prec, least(greatest(100 * exp(17.67 * td / (243.5 + td) - 17.67 * temp / (243.5 + temp)), 1), 100) AS rh FROM (
    SELECT *, 243.5 * g / (17.67 - g) AS td FROM (SELECT *, ln(least(greatest(rh0, 0.001), 100) / 100) + 17.67 * t0 / (243.5 + t0) AS g FROM dw)))"""


def _down(i: Inputs, zones: DataFrame) -> DataFrame:
    table = zonal.zone_table(zones, i.grid, "elev", lat=i.grid.y("row") / 1000, station="station")
    return zonal.downscale(i.weather(), table, wind=_wind(i, zones), rain_slope=0.001)


@query("downscaled_weather", "D04", sql(
    f"""SELECT zone, count(*) AS days, {rd('avg(temp)')} AS temp, {rd('avg(rh)')} AS rh, {rd('avg(ws)')} AS ws, {rd('avg(prec)')} AS prec FROM down GROUP BY zone""",
    _ZONES, _CURVE, _DOWN))
def downscaled_weather(i: Inputs) -> DataFrame:
    return _down(i, cut_lineage(_zones(i))).groupBy("zone").agg(F.count("*").alias("days"), *[F.avg(c).alias(c) for c in ("temp", "rh", "ws", "prec")])


@query("zonal_fwi_painted", "D05 J14", sql(
    f"""SELECT d AS date, r AS "row", c AS "col", zone, {rd('fwi', 4)} AS value FROM codes JOIN (SELECT r, c, zone FROM zones) USING (zone)
        WHERE d IN (DATE '1997-06-10', DATE '1999-08-15', DATE '2000-07-01')""",
    _ZONES, _CURVE, _DOWN, _recurrence("down", "zone")))
def zonal_fwi_painted(i: Inputs) -> DataFrame:
    zones = cut_lineage(_zones(i))
    dates = [dt.date(1997, 6, 10), dt.date(1999, 8, 15), dt.date(2000, 7, 1)]
    wanted = zonal.zonal_fwi(_down(i, zones), dates=dates)
    return _short(zonal.paint(zones, wanted), ["value"])


@query("weather_trimmed_zone_means", "A05 M11", sql(
    f"""SELECT zone, count(*) AS n_cells, {rd('avg(elev)')} AS elev_mean FROM zones JOIN burnt USING (r, c) GROUP BY zone""", _ZONES))
def trimmed_zone_means(i: Inputs) -> DataFrame:
    kept = raster.trim(_zones(i), i.grid, i.fires(), "fire_id")
    return kept.groupBy("zone").agg(F.count("*").alias("n_cells"), F.avg("elev").alias("elev_mean"))


def _drain(stream: DataFrame, i: Inputs, name: str) -> DataFrame:
    """Run a stream over what has landed and read its sink back."""
    path = scratch_path(i.spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(
        availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return i.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_daily_noon", "T01", sql(
    f"""SELECT id, CAST(we AS DATE) AS date, {rd('arg_max(v % 300 / 10.0, ts) FILTER (hour(ts) = 12)')} AS temp, {rd('sum(v) / 100.0')} AS prec
        FROM (SELECT user_id AS id, ts, CAST(round(value * 100) AS BIGINT) AS v, CAST(ts + INTERVAL 11 HOUR AS DATE)::TIMESTAMP + INTERVAL 13 HOUR - INTERVAL 1 MICROSECOND AS we FROM events)
        WHERE we + INTERVAL 1 MICROSECOND <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY id, we HAVING count(*) FILTER (hour(ts) = 12) > 0"""))
def stream_daily_noon(i: Inputs) -> DataFrame:
    schema = i.table("events").schema
    raw = i.spark.readStream.schema(schema).parquet(f"{i.dir}/events*.parquet")
    v = F.round(F.col("value") * 100).cast("long")
    hourly = raw.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (v % 300 / 10).alias("temp"), F.lit(50.0).alias("rh"), F.lit(10.0).alias("ws"), (v / 100).alias("prec"))
    daily = _drain(weather_stream.daily_stream(hourly), i, "daily")
    return daily.select("id", "date", "temp", "prec")


@query("stream_station_codes", "T02", sql(
    f"""SELECT id, d AS date, {_seven()}, CASE WHEN d - lag(d) OVER (PARTITION BY id ORDER BY d) > 1 THEN 'gap' ELSE 'ok' END AS status FROM codes""",
    _recurrence("weather", "id")))
def stream_station_codes(i: Inputs) -> DataFrame:
    landed = scratch_path(i.spark, "landed")
    days = i.weather().select("id", "date", "lat", "temp", "rh", "ws", "prec")
    days.write.parquet(landed)
    stream = i.spark.readStream.schema(days.schema).parquet(landed)
    return _short(_drain(weather_stream.codes_stream(stream), i, "codes"), fwi.CODES)
