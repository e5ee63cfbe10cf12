"""Queries of source preparation, provenance and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.grid import CELL, Layer
from emberline.operators import focal, provenance
from emberline.plans.catalog_grid import _focal, _ring
from emberline.plans.inputs import Inputs, rd, sql
from emberline.plans.registry import query
from emberline.session import scratch_path
from emberline.sources import burnt, clearcut, landcover, lidar, rasters, scenes, stack_io

_BURNT = """bp AS (SELECT o_orderkey AS fid, CAST(o_orderdate AS DATE) AS fire_date, CAST(year(o_orderdate) AS INTEGER) AS fire_year,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey + 0.5 END AS area_ha FROM orders)"""


@query("burnt_prepared", "S06", sql(f"SELECT fid, fire_date, fire_year, {rd('area_ha')} AS area_ha FROM bp", _BURNT))
def burnt_prepared(i: Inputs) -> DataFrame:
    return burnt.prepare_burnt(i.burnt_raw()).select("fid", "fire_date", "fire_year", "area_ha")


@query("burnt_outline_area", "S06", sql(
    f"SELECT fire_id, {rd('2 * h * h / 10000')} AS area_ha FROM (SELECT fire_id, side * 25 / 2.0 + 5 AS h FROM fires)"))
def burnt_outline_area(i: Inputs) -> DataFrame:
    raw = i.diamonds().withColumn("FIREDATE", F.lit("2020/01/01"))
    return burnt.prepare_burnt(raw).select("fire_id", "area_ha")


@query("burnt_in_period", "S07", sql("SELECT fid, fire_year FROM bp WHERE fire_year BETWEEN 1997 AND 1999", _BURNT))
def burnt_in_period(i: Inputs) -> DataFrame:
    return burnt.burnt_in_period(burnt.prepare_burnt(i.burnt_raw()), 1997, 1999).select("fid", "fire_year")


@query("burnt_period_report", "S07", sql(
    f"""SELECT 1990 AS asked_first, 1999 AS asked_last, min(fire_year) AS have_first, max(fire_year) AS have_last, count(*) FILTER (fire_year BETWEEN 1990 AND 1999) AS n_fires,
          {rd('sum(CASE WHEN fire_year BETWEEN 1990 AND 1999 THEN area_ha END)')} AS area_ha, min(fire_year) > 1990 OR max(fire_year) < 1999 AS truncated FROM bp""", _BURNT))
def burnt_period_report(i: Inputs) -> DataFrame:
    return burnt.period_report(burnt.prepare_burnt(i.burnt_raw()), 1990, 1999)


@query("survey_vintages", "A19 S09", sql(
    f"""SELECT dep, CAST(year(date_vol) AS INTEGER) AS year, max(pva) AS pva, min(date_vol) AS date_vol, count(*) AS n_polygons,
          {rd('round_even(100 * sum(area) / sum(sum(area)) OVER (), 1)')} AS pct_area FROM survey WHERE year(date_vol) BETWEEN 2007 AND 2018 GROUP BY 1, 2"""))
def survey_vintages(i: Inputs) -> DataFrame:
    return landcover.survey_vintages(i.survey())


@query("survey_oldest_per_department", "A19 S09", sql(
    "SELECT dep, CAST(min(year(date_vol)) AS INTEGER) AS year FROM survey WHERE year(date_vol) BETWEEN 2007 AND 2018 GROUP BY 1"))
def survey_oldest(i: Inputs) -> DataFrame:
    return landcover.vintage_per_department(landcover.survey_vintages(i.survey())).select("dep", "year")


@query("landcover_raster", "S10 J08", sql(
    """SELECT r AS "row", c AS "col", CAST(arg_min(code, tile) AS VARCHAR) AS class FROM (
         SELECT r, c, tile, min(CAST(swir AS INTEGER) // 5000 * 10) AS code FROM bands GROUP BY r, c, tile) WHERE code <> 0 GROUP BY r, c"""))
def landcover_raster(i: Inputs) -> DataFrame:
    code = F.expr("cast(swir as int) div 5000 * 10").cast("int")
    tiles = i.bands().groupBy(*CELL, "tile").agg(F.min(code).alias("code"))
    return landcover.class_raster(tiles, i.grid)


@query("landcover_unknown_codes", "S10", sql(
    "SELECT class, count(*) AS cells FROM cells WHERE class IS NOT NULL AND class NOT IN (SELECT code FROM lookup) GROUP BY class"))
def landcover_unknown(i: Inputs) -> DataFrame:
    return landcover.unknown_codes(i.cells(), i.lookup())


def _points(i: Inputs) -> DataFrame:
    return i.table("customer").select("c_custkey", (F.col("c_custkey") * 7 % 360 - 180 + 0.25).alias("lon"), (F.col("c_custkey") * 11 % 160 - 80 + 0.25).alias("lat"))


def _tile_sql(step: int) -> str:
    lat, lon = f"CAST(floor(lat / {step}) * {step} AS INTEGER)", f"CAST(floor(lon / {step}) * {step} AS INTEGER)"
    return f"CASE WHEN {lat} < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs({lat}) AS VARCHAR), 2, '0') || CASE WHEN {lon} < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs({lon}) AS VARCHAR), 3, '0')"


_PTS = "pts AS (SELECT c_custkey, c_custkey * 7 % 360 - 180 + 0.25 AS lon, c_custkey * 11 % 160 - 80 + 0.25 AS lat FROM customer)"


@query("degree_tiles", "S11", sql(f"SELECT {_tile_sql(3)} AS tile, count(*) AS points FROM pts GROUP BY 1", _PTS))
def degree_tiles(i: Inputs) -> DataFrame:
    return rasters.with_degree_tile(_points(i), "lon", "lat", 3).groupBy("tile").agg(F.count("*").alias("points"))


@query("elevation_tiles", "S11", sql(f"SELECT c_custkey, {_tile_sql(1)} AS tile FROM pts", _PTS))
def elevation_tiles(i: Inputs) -> DataFrame:
    return rasters.with_degree_tile(_points(i), "lon", "lat", 1).select("c_custkey", "tile")


@query("metric_tiles", "S11", sql(
    """SELECT 'R' || CAST(floor((9000000 - lat * 100000) / 1000000) AS INTEGER) || '_C' || CAST(floor((lon * 100000 + 18041000) / 1000000) + 1 AS INTEGER) AS tile, count(*) AS points
       FROM pts GROUP BY 1""", _PTS))
def metric_tiles(i: Inputs) -> DataFrame:
    pts = _points(i).select((F.col("lon") * 100000).alias("x"), (F.col("lat") * 100000).alias("y"))
    return rasters.with_metric_tile(pts, "x", "y", -18041000.0, 9000000.0).groupBy("tile").agg(F.count("*").alias("points"))


@query("elevation_range", "S12", sql("SELECT min(elev) AS elev_min, max(elev) AS elev_max, count(elev) AS n FROM cells"))
def elevation_range(i: Inputs) -> DataFrame:
    return rasters.elevation_range(i.cells())


@query("structure_metric", "S14 S22", sql(
    f"""SELECT r AS "row", c AS "col", {rd('CASE WHEN metric <> -1 THEN metric END')} AS height FROM cells"""))
def structure_metric(i: Inputs) -> DataFrame:
    cells = i.cells().select(*CELL, F.nullif(F.col("metric"), F.lit(-1.0)).alias("height"))
    return rasters.structure(cells, i.grid, i.grid, "height", "m").df


_CUTS = """cut AS (SELECT r, c, 2000 + code // 1000 AS cut_year, code % 1000 AS cut_doy, prob FROM (
  SELECT r, c, CASE WHEN pop < 10 THEN 0 ELSE CAST(18 + cust % 8 AS INTEGER) * 1000 + 1 + CAST(elev AS INTEGER) % 365 END AS code, grade * 100 AS prob FROM cells) WHERE code <> 0)"""


def _cut_codes(i: Inputs) -> DataFrame:
    code = F.when(F.col("pop") < 10, 0).otherwise((18 + F.col("cust") % 8) * 1000 + 1 + F.col("elev").cast("int") % 365).cast("int")
    return i.cells().select(*CELL, code.alias("code"), (F.col("grade") * 100).alias("prob"))


@query("clear_cuts", "S15", sql(
    """SELECT r AS "row", c AS "col", CAST(cut_year AS INTEGER) AS cut_year, CAST(cut_doy AS INTEGER) AS cut_doy FROM cut
       WHERE prob >= 40 AND cut_year IN (2019, 2021, 2022) AND (r, c) NOT IN (SELECT (r, c) FROM burnt)""", _CUTS))
def clear_cuts(i: Inputs) -> DataFrame:
    return clearcut.clear_cuts(_cut_codes(i), prob="prob", min_prob=40, years=[2019, 2021, 2022], burnt=i.burnt()).select(*CELL, "cut_year", "cut_doy")


@query("clear_cuts_by_year", "S15", sql(
    f"""SELECT CAST(cut_year AS INTEGER) AS cut_year, count(*) AS cells, {rd('count(*) * 0.0625')} AS area_ha FROM cut WHERE (r, c) NOT IN (SELECT (r, c) FROM burnt) GROUP BY 1""", _CUTS))
def clear_cuts_by_year(i: Inputs) -> DataFrame:
    return clearcut.cut_report(clearcut.clear_cuts(_cut_codes(i), burnt=i.burnt()), i.grid)


@query("scene_candidates", "S16 W04", sql(
    f"""SELECT d AS date, {rd('avg(cloud)')} AS cloud, count(*) AS n_tiles FROM (SELECT d, tile, arg_min(cloud, scene) AS cloud FROM catalog GROUP BY d, tile) GROUP BY d HAVING avg(cloud) <= 45"""))
def scene_candidates(i: Inputs) -> DataFrame:
    return scenes.scene_candidates(i.catalog(), 45)


@query("scene_first_candidates", "W04 S16", sql(
    f"""SELECT d AS date, {rd('avg(cloud)')} AS cloud, count(*) AS n_tiles FROM (SELECT d, tile, arg_min(cloud, scene) AS cloud FROM catalog
        WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY d, tile) GROUP BY d HAVING avg(cloud) <= 45 ORDER BY avg(cloud), d LIMIT 4"""))
def scene_first(i: Inputs) -> DataFrame:
    year = F.col("date").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return scenes.first_candidates(scenes.scene_candidates(i.catalog(), 45, year), 4)


@query("fire_scene_windows", "S16", sql(
    """SELECT fire_start, fire_end, fire_start - 48 AS pre_from, fire_start - 3 AS pre_to, fire_end + 3 AS post_from, fire_end + 48 AS post_to FROM (
       SELECT CAST(min(o_orderdate) AS DATE) AS fire_start, CAST(max(o_orderdate) AS DATE) AS fire_end FROM orders)"""))
def fire_windows(i: Inputs) -> DataFrame:
    text = i.burnt_raw().select(F.col("FireDate").alias("FIREDATE"), F.col("FireDate").alias("FINALDATE"))
    return scenes.scene_windows(burnt.fire_span(text))


_NBR = """nb AS (SELECT scene, r, c, arg_min((nir - swir) / (nir + swir), tile) AS nbr FROM bands WHERE nir + swir <> 0 GROUP BY scene, r, c),
ch AS (SELECT a.scene, a.r, a.c, a.nbr - b.nbr AS dnbr FROM nb a JOIN nb b ON b.r = a.r AND b.c = a.c WHERE a.scene < 7 AND b.scene = 7)"""


def _change(i: Inputs) -> DataFrame:
    ratio = scenes.nbr(i.bands())
    return scenes.dnbr(ratio.filter("scene < 7"), ratio.filter("scene = 7"))


@query("dnbr_cells", "S17", sql(f'SELECT scene, r AS "row", c AS "col", {rd("dnbr")} AS dnbr FROM ch', _NBR))
def dnbr_cells(i: Inputs) -> DataFrame:
    return _change(i)


@query("pre_scene_rank", "S18 W04 A03", sql(
    f"""SELECT scene, {rd('coverage')} AS coverage, {rd('control')} AS control, CAST(row_number() OVER (ORDER BY abs(control) NULLS LAST, scene) AS INTEGER) AS rank FROM (
        SELECT scene, count(dnbr) / (max(w)::DOUBLE * max(w)) AS coverage, median(dnbr) FILTER ((r, c) NOT IN (SELECT (r, c) FROM burnt)) AS control FROM ch, dims GROUP BY scene) WHERE coverage >= 0.18""", _NBR))
def pre_scene_rank(i: Inputs) -> DataFrame:
    return scenes.rank_pre_scenes(_change(i), i.burnt(), i.grid.ncell, min_coverage=0.18)


@query("tile_coverage", "S20", sql(
    f"""SELECT {rd('100.0 * count(*) FILTER (seen) / count(*)')} AS coverage_pct, (SELECT count(*) FROM tile_index) AS n_tiles,
          (SELECT array_to_string(list_sort(list(DISTINCT substr(timestamp, 1, 4))), ',') FROM tile_index) AS years, (SELECT count(DISTINCT block) FROM tile_index) AS n_blocks
        FROM (SELECT EXISTS (SELECT 1 FROM tile_index t WHERE (c + 0.5) * 25 >= xmin AND (c + 0.5) * 25 < xmax AND (w - r - 0.5) * 25 > ymin AND (w - r - 0.5) * 25 <= ymax) AS seen FROM cells)"""))
def tile_coverage(i: Inputs) -> DataFrame:
    got = lidar.tile_coverage(i.tile_index(), i.cells(), i.grid)
    return got.withColumn("years", F.array_join("years", ","))


@query("pulse_density", "S21", sql(
    f"""SELECT tr, tc, count(*) AS n_points, count(*) FILTER (l_linenumber = 1) AS n_pulses, {rd('round_even(count(*) FILTER (l_linenumber = 1) / 100.0, 2)')} AS pulses_per_m2,
          {rd('round_even(count(*) / 100.0, 2)')} AS points_per_m2, count(*) FILTER (l_linenumber = 1) / 100.0 < 10 AS below_spec
        FROM (SELECT CAST(l_orderkey // w // 16 AS INTEGER) AS tr, CAST(l_orderkey % w // 16 AS INTEGER) AS tc, l_linenumber FROM lineitem, dims) GROUP BY tr, tc"""))
def pulse_density(i: Inputs) -> DataFrame:
    pts = i.table("lineitem").select(*i._at("l_orderkey"), F.col("l_linenumber").alias("return_number"))
    pts = pts.withColumns({"tr": F.expr("cast(row div 16 as int)"), "tc": F.expr("cast(col div 16 as int)")})
    return lidar.density(pts, ["tr", "tc"], 100.0)


@query("metrics_cleaned", "S22", sql(
    """SELECT r AS "row", c AS "col", nullif(metric, -1) AS "Height", nullif(elev, -1) AS "CBH" FROM cells"""))
def metrics_cleaned(i: Inputs) -> DataFrame:
    table = i.cells().select(*CELL, F.col("metric").alias("Height"), F.col("elev").alias("CBH"))
    return lidar.clean_metrics(table, lidar.select_metrics(["Height", "CBH"]))


@query("window_fire_check", "J11", sql(
    """SELECT name, count(*) AS n_fires, max(fire_year) AS last_fire, bool_or(fire_year > flight - 18) AS burnt_after_flight FROM (
       SELECT name, xmin, xmax, ymin, ymax, CAST(substr(timestamp, 1, 4) AS INTEGER) AS flight FROM tile_index) t JOIN fires f
       ON greatest(xmin - (c0 + 6) * 25, (c0 + 6) * 25 - xmax, 0) + greatest(ymin - (w - r0 - 6) * 25, (w - r0 - 6) * 25 - ymax, 0) < side * 25 / 2.0 + 5 GROUP BY name"""))
def window_fire_check(i: Inputs) -> DataFrame:
    windows = i.tile_index().withColumn("flight_year", F.substring("timestamp", 1, 4).cast("int") - 18)
    burns = i.diamonds().withColumns({
        "xmin": F.col("x") - F.col("h"), "xmax": F.col("x") + F.col("h"), "ymin": F.col("y") - F.col("h"), "ymax": F.col("y") + F.col("h")})
    return lidar.fire_check(windows, burns, width=200.0)


@query("batch_plan", "J12", sql(
    """SELECT name, CASE WHEN name IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'done'
         WHEN xmin < 1500 AND xmax > 250 AND ymin < 1500 AND ymax > 250 THEN 'todo' ELSE 'outside' END AS status FROM tile_index"""))
def batch_plan(i: Inputs) -> DataFrame:
    manifest = i.table("lineitem").select(F.col("l_partkey").alias("name"), F.when(F.col("l_quantity") == 50, "written").otherwise("failed").alias("status"))
    return lidar.batch_plan(i.tile_index(), manifest, (250.0, 250.0, 1500.0, 1500.0)).select("name", "status")


@query("licence_report", "A21", sql(
    """SELECT dataset, arg_min(struct_pack(l := licence), seq).l AS licence, arg_min(licence_from, seq) AS licence_from,
         coalesce(contains(arg_min(struct_pack(l := licence), seq).l, 'NC'), false) AS non_commercial FROM source_log GROUP BY dataset"""))
def licence_report(i: Inputs) -> DataFrame:
    return provenance.licences(i.source_log())


@query("sources_merged", "U03 X01", sql(
    "SELECT dataset, vintage, min(seq) AS seq FROM source_log GROUP BY dataset, vintage"))
def sources_merged(i: Inputs) -> DataFrame:
    return provenance.merge_sources(i.source_log().select("dataset", "vintage", "seq", "licence"), ["dataset", "vintage"], "seq").select("dataset", "vintage", "seq")


@query("steps_renumbered", "U03 X01", sql(
    "SELECT run, seq AS at, CAST(row_number() OVER (PARTITION BY run ORDER BY seq) AS INTEGER) AS seq FROM source_log"))
def steps_renumbered(i: Inputs) -> DataFrame:
    steps = i.source_log().select("run", F.col("seq").alias("at"))
    return provenance.renumber_steps(steps, "run", "at")


@query("vintage_resolved", "A09", sql(
    "SELECT run, arg_min(vintage, seq) AS vintage FROM source_log WHERE vintage IS NOT NULL GROUP BY run"))
def vintage_resolved(i: Inputs) -> DataFrame:
    return provenance.resolve_vintage(i.source_log(), "run")


@query("stack_round_trip", "S23 A01", sql(
    f"""SELECT layer, {rd('sum(v)')} AS total, count(v) AS n_valid, count(*) AS cells FROM (SELECT 'elev' AS layer, elev AS v FROM cells UNION ALL SELECT 'holed', holed FROM cells) GROUP BY layer"""))
def stack_round_trip(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stack")
    cells = i.cells()
    stack = {n: Layer(cells, i.grid, n, "raw", "").derive(cells, n, "derive", {"layer": n}) for n in ("elev", "holed")}
    stack_io.save_stack(stack, path)
    back = stack_io.read_stack(i.spark, path)
    parts = [layer.df.select(F.lit(n).alias("layer"), "value") for n, layer in back.items()]
    return parts[0].unionByName(parts[1]).groupBy("layer").agg(
        F.sum("value").alias("total"), F.count("value").alias("n_valid"), F.count("*").alias("cells"))


@query("provenance_appended", "S24 X01", sql(
    "SELECT run, count(*) AS records, count(vintage) AS dated, count(DISTINCT dataset) AS datasets FROM source_log GROUP BY run"))
def provenance_appended(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "provenance")
    stack_io.append_records(i.source_log(), path)
    return i.spark.read.parquet(path).groupBy("run").agg(
        F.count("*").alias("records"), F.count("vintage").alias("dated"), F.count_distinct("dataset").alias("datasets"))


@query("exposure_written", "S25 N03", sql(
    f"""SELECT r AS "row", c AS "col", CASE WHEN n = 48 THEN {rd('s / 48.0')} END AS exposure FROM foc""",
    _ring(100), _focal("grade")))
def exposure_written(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "exposure")
    made = focal.exposure(i.cells(), i.grid, "grade", 100).select(*CELL, "exposure")
    stack_io.write_cells(made, path, band=16)
    return i.spark.read.parquet(path).select(*CELL, "exposure")
