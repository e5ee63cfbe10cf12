"""Queries that land data and read it back, and those whose layers lie on different grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.grid import CELL, GridSpec
from emberline.operators import fuel, validate, zonal
from emberline.plans.catalog_grid import _auc_sql, _shifted
from emberline.plans.inputs import RES, Inputs, rd, sql
from emberline.plans.registry import query
from emberline.session import scratch_path
from emberline.sources import lookup, rasters
from emberline.sources import weather as src

#: Cells on a side of a landed block.
BLOCK = 96


@query("danger_grid_window", "S19 S11 S25", sql(
    f"""SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS date, r AS "row", c AS "col", grade AS value FROM (
          SELECT *, CAST(o_orderkey // w AS INTEGER) AS r, CAST(o_orderkey % w AS INTEGER) AS c, (cents % 101) / 100.0 AS grade FROM o1, dims)
        WHERE year(o_orderdate) BETWEEN 1994 AND 1995 AND (r // {BLOCK}, c // {BLOCK}) IN (SELECT DISTINCT (r // {BLOCK}, c // {BLOCK}) FROM fire_cells JOIN fires USING (fire_id) WHERE fires.fire_id % 40 = 3)"""))
def danger_grid_window(i: Inputs) -> DataFrame:
    """A dated grid landed by date and block, read by two dates and the blocks of some fires."""
    path = scratch_path(i.spark, "danger-grid")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = i.table("orders").select(F.trunc("o_orderdate", "year").alias("date"), *i._at("o_orderkey"), (cents % 101 / 100).alias("value"))
    rasters.write_dated(rows, path, BLOCK)
    blocks = rasters.blocks_of_area(i.fires().filter("fire_id % 40 = 3"), i.grid, BLOCK)
    return rasters.danger_series(i.spark, path, "1994-01-01", "1995-12-31", blocks)


def _bilinear(name: str, source: str, v: str, res: float, n: str, to: float, m: str) -> str:
    """Named SQL parts: column ``v`` of a layer (r, c) of ``n`` cells a side on another grid with the same corner."""
    ratio = to / res
    return f"""{name}_t AS (SELECT fr, fc, least(greatest((fr + 0.5) * {ratio} - 0.5, 0), n - 1) AS fy, least(greatest((fc + 0.5) * {ratio} - 0.5, 0), n - 1) AS fx
         FROM (SELECT n, m, unnest(range(0, m)) AS fr FROM (SELECT CAST({n} AS BIGINT) AS n, CAST({m} AS BIGINT) AS m FROM dims)), LATERAL (SELECT unnest(range(0, m)) AS fc)
         WHERE (fr + 0.5) * {ratio} <= n AND (fc + 0.5) * {ratio} <= n),
       {name}_f AS (SELECT fr, fc, floor(fy) + dy AS sr, floor(fx) + dx AS sc,
         (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS wt
         FROM {name}_t, range(0, 2) a(dy), range(0, 2) b(dx) WHERE wt > 0),
       {name} AS (SELECT CAST(fr AS INTEGER) AS r, CAST(fc AS INTEGER) AS c, CASE WHEN count(*) = count(v) THEN sum(wt * v) END AS v
         FROM {name}_f LEFT JOIN (SELECT r AS sr, c AS sc, {v} AS v FROM {source}) USING (sr, sc) GROUP BY fr, fc)"""


@query("structure_regridded", "S14 J06", sql(
    f"""SELECT r AS "row", c AS "col", {rd('v')} AS height FROM bi""",
    _bilinear("bi", "cells", "CASE WHEN metric <> -1 THEN metric END", 25, "w", 10, "floor(w * 2.5)")))
def structure_regridded(i: Inputs) -> DataFrame:
    cells = i.cells().select(*CELL, F.nullif(F.col("metric"), F.lit(-1.0)).alias("height"))
    return rasters.structure(cells, i.grid, _shifted(i, 10.0), "height", "m").df


@query("refined_ten_times", "J06", sql(
    f"""SELECT r AS "row", c AS "col", {rd('v')} AS elev FROM bi""",
    "block AS (SELECT r // 10 AS r, c // 10 AS c, avg(elev) AS e FROM cells GROUP BY ALL)",
    _bilinear("bi", "block", "e", 250, "ceil(w / 10.0)", 25, "w")))
def refined_ten_times(i: Inputs) -> DataFrame:
    from emberline.operators.raster import align

    n = -(-i.side // 10)
    coarse = i.cells().groupBy(F.expr("row div 10").cast("int").alias("row"), F.expr("col div 10").cast("int").alias("col")).agg(F.avg("elev").alias("elev"))
    return align(coarse, GridSpec(0.0, i.grid.ymax, 10 * RES, n, n), i.grid, ["elev"], "bilinear")


@query("attach_regridded", "J10 J06", sql(
    f"""SELECT cells.r AS "row", cells.c AS "col", class, {rd('v')} AS height FROM cells LEFT JOIN bi ON bi.r = cells.r AND bi.c = cells.c""",
    "block AS (SELECT r // 2 AS r, c // 2 AS c, avg(elev) AS e FROM cells GROUP BY ALL)",
    _bilinear("bi", "block", "e", 50, "ceil(w / 2.0)", 25, "w")))
def attach_regridded(i: Inputs) -> DataFrame:
    """A metric on cells twice as wide, carried beside the class of the finer grid."""
    n = -(-i.side // 2)
    coarse = i.cells().groupBy(F.expr("row div 2").cast("int").alias("row"), F.expr("col div 2").cast("int").alias("col")).agg(F.avg("elev").alias("height"))
    base = fuel.FuelSource.from_cells(i.cells().select(*CELL, "class"), i.grid, "worldcover", i.lookup())
    return base.attach(coarse, GridSpec(0.0, i.grid.ymax, 2 * RES, n, n), {"height": "m"}).df.select(*CELL, "class", "height")


_T = """fit AS (SELECT CAST(count(*) AS INTEGER) AS n_points, regr_slope(p, elev_m) AS slope, regr_r2(p, elev_m) AS r2, avg(p) AS mean_prec
  FROM (SELECT id, elev_m, avg(prec) AS p FROM weather GROUP BY id, elev_m)),
angle AS (SELECT *, n_points - 2 AS df, atan(sqrt(r2 / (1 - r2))) AS a FROM fit),
tail AS (SELECT sum(pow(cos(a + (k + 0.5) * (pi() / 2 - a) / 100000), df - 1)) * (pi() / 2 - a) AS beyond,
  sum(pow(cos((k + 0.5) * pi() / 2 / 100000), df - 1)) * pi() / 2 AS total FROM angle, range(0, 100000) g(k) GROUP BY a, df)"""


@query("rain_gate", "A07", sql(
    f"""SELECT n_points, {rd('slope')} AS slope, {rd('1000 * slope / mean_prec')} AS relative, {rd('beyond / total', 5)} AS p_value, beyond / total <= 0.05 AS usable FROM fit, tail""", _T))
def rain_gate(i: Inputs) -> DataFrame:
    """Whether the rain gradient may be used, by its p-value; the twin integrates Student's density."""
    r = zonal.rain_gradient(i.weather())
    return i.spark.createDataFrame(
        [(r["n_points"], r["slope"], r["relative"], round(r["p_value"], 5), r["usable"])], "n_points int, slope double, relative double, p_value double, usable boolean")


@query("risk_validation", "A13", sql(
    f"""SELECT CAST(bin AS INTEGER) AS bin, cells AS cells_total, hit AS cells_burnt, {rd('auc')} AS auc, n_pos + n_neg AS n_cells, n_pos AS n_burnt
        FROM (SELECT bin, count(v) AS cells, count(v) FILTER (p = 1) AS hit FROM range(1, 6) g(bin) LEFT JOIN binned USING (bin) GROUP BY bin), {_auc_sql('sc')}""",
    """early AS (SELECT DISTINCT fc.r, fc.c FROM fire_cells fc JOIN fires USING (fire_id) WHERE fire_year - 1996 <= 3),
    sc AS (SELECT holed AS v, CASE WHEN early.r IS NULL THEN 0 ELSE 1 END AS p FROM cells LEFT JOIN early USING (r, c) WHERE holed IS NOT NULL),
    binned AS (SELECT v, p, CASE WHEN v < 0.2 THEN 1 WHEN v <= 0.4 THEN 2 WHEN v <= 0.6 THEN 3 WHEN v <= 0.8 THEN 4 ELSE 5 END AS bin FROM sc)"""))
def risk_validation(i: Inputs) -> DataFrame:
    v = validate.validate(i.cells(), i.grid, "holed", i.fires(), "fire_id", vintage=1996, max_lag=3)
    return v.classes.select("bin", "cells_total", "cells_burnt", F.lit(v.auc).alias("auc"), F.lit(v.n_cells).cast("long").alias("n_cells"), F.lit(v.n_burnt).cast("long").alias("n_burnt"))


@query("lookup_from_csv", "S01", sql(
    "SELECT class, fuel_type, burnable, count(*) AS cells FROM cells JOIN lookup ON code = class GROUP BY class, fuel_type, burnable"))
def lookup_from_csv(i: Inputs) -> DataFrame:
    """Cells by the lookup of the classes in use, after that lookup went through a CSV file."""
    path = scratch_path(i.spark, "lookup")
    used = i.cells().select("class").distinct()
    i.lookup().join(used, F.col("code") == F.col("class"), "left_semi").write.option("header", True).csv(path)
    table = lookup.read_lookup(i.spark, path)
    return i.cells().join(table, F.col("code") == F.col("class")).groupBy("class", "fuel_type", "burnable").agg(F.count("*").alias("cells"))


@query("hourly_from_json", "S03 S05", sql(
    f"""SELECT id, CAST(d AS DATE) AS date, {rd('temp')} AS temp, rh, ws, CAST(elev_m AS DOUBLE) AS elev_m,
          {rd('(SELECT coalesce(sum(p.prec), 0) FROM hourly p WHERE p.id = n.id AND p.ts BETWEEN n.ts - INTERVAL 23 HOUR AND n.ts)')} AS prec
        FROM (SELECT *, CAST(ts AS DATE) AS d FROM hourly WHERE hour(ts) = 6) n LEFT JOIN (SELECT id, elev_m FROM stations) USING (id)"""))
def hourly_from_json(i: Inputs) -> DataFrame:
    """Hourly series landed as JSON, a point on each line, and read back into days."""
    path = scratch_path(i.spark, "hourly-json")
    served = i.stations().select("id", F.lit(None).cast("double").alias("cell_lat"), F.lit(None).cast("double").alias("cell_long"), "elev_m")
    src.hourly_lines(i.hourly(), served).write.json(path)
    hourly, cells = src.read_hourly_lines(i.spark, path)
    days = src.with_served(src.daily_from_hourly(hourly, 6), cells.select("id", "elev_m"))
    return days.select("id", "date", "temp", "rh", "ws", "elev_m", "prec")
