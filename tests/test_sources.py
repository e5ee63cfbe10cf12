import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest

from emberline.errors import BadLookup, BadWeather, BadWeights, EmberError, UnknownName
from emberline.functions.constants import FUEL_TYPES, NOMENCLATURES
from emberline.grid import GridSpec, Layer
from emberline.operators import fuel, provenance
from emberline.operators.provenance import Provenance
from emberline.operators.raster import rectangle
from emberline.sources import burnt, clearcut, landcover, lidar, lookup, rasters, scenes, stack_io, weather
from pyspark.sql import functions as F


def test_builtin_nomenclatures(spark):
    sizes = {n: lookup.builtin_lookup(spark, n).count() for n in NOMENCLATURES}
    assert sizes == {"bdforet_v2": 32, "clc": 44, "worldcover": 11}
    assert len(FUEL_TYPES) == 19
    got = {r["code"]: r for r in lookup.builtin_lookup(spark, "clc").collect()}
    assert got["323"]["fuel_type"] == "shrubland" and got["323"]["burnable"] and not got["211"]["burnable"]
    for n in NOMENCLATURES:
        lookup.validate_lookup(lookup.builtin_lookup(spark, n))


@pytest.mark.parametrize("rows,what", [
    (["1,shrubland,yes", "1,shrubland,no"], "duplicate"), (["1,shrubland,maybe"], "unreadable"), (["1,lava,yes"], "unknown")])
def test_bad_lookups(spark, tmp_path, rows, what):
    f = tmp_path / "l.csv"
    f.write_text("\n".join(["code,fuel_type,burnable", *rows]))
    with pytest.raises(BadLookup, match=what):
        lookup.read_lookup(spark, str(f))


def test_good_lookup_fills_optional_columns(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("code,fuel_type,burnable\nA,shrubland,Y\nB,non_fuel,0\n")
    got = {r["code"]: r for r in lookup.read_lookup(spark, str(f)).collect()}
    assert got["A"]["burnable"] is True and got["B"]["burnable"] is False and got["A"]["notes"] is None
    f.write_text("code,burnable\nA,Y\n")
    with pytest.raises(BadLookup, match="lacks"):
        lookup.read_lookup(spark, str(f))


def response(n_points, hours=48):
    start = dt.datetime(2021, 8, 15)
    one = [{"latitude": 43.0 + k, "longitude": 6.0, "elevation": 100.0 * (k + 1), "hourly": {
        "time": [(start + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(hours)],
        "temperature_2m": [float(h) for h in range(hours)], "relative_humidity_2m": [50.0] * hours, "wind_speed_10m": [5.0] * hours,
        "precipitation": [1.0 if h != 20 else None for h in range(hours)]}} for k in range(n_points)]
    return json.dumps(one[0] if n_points == 1 else one)


@pytest.mark.parametrize("n", [1, 4])
def test_hourly_json_to_days(spark, tmp_path, n):
    f = tmp_path / "w.json"
    f.write_text(response(n))
    hourly, served = weather.read_hourly_json(spark, str(f), [10 + k for k in range(n)])
    days = weather.daily_from_hourly(hourly, 12).orderBy("id", "date").collect()
    assert len(days) == 2 * n and served.count() == n
    assert days[0]["prec"] == 13 and days[1]["prec"] == 23 and days[1]["temp"] == 36
    late = weather.daily_from_hourly(hourly, 12, "2021-08-16")
    assert late.count() == n
    assert weather.with_served(late, served).filter("elev_m is null").count() == 0
    for wrong in (n + 1, n - 1):
        with pytest.raises(Exception, match="BadWeather"):
            weather.read_hourly_json(spark, str(f), list(range(wrong)))[0].collect()
    lines = str(tmp_path / "lines")
    weather.hourly_lines(hourly, served).write.json(lines)
    again, cells = weather.read_hourly_lines(spark, lines)
    assert sorted(again.collect()) == sorted(hourly.collect()) and sorted(cells.collect()) == sorted(served.collect())


def test_dated_grids_prune_by_dates_and_by_the_areas_blocks(spark, tmp_path):
    grid, path = GridSpec(0, 100, 1, 100, 100), str(tmp_path / "dated")
    cells = grid.cells(spark).withColumn("value", F.col("row") * 1000.0 + F.col("col"))
    rows = cells.withColumn("date", F.explode(F.sequence(F.lit("2020-06-01").cast("date"), F.lit("2020-06-05").cast("date"))))
    rasters.write_dated(rows, path, side=25)
    box = spark.createDataFrame([(1, 30.0, 10.0, 49.0, 20.0)], "fid int, a double, b double, c double, d double")
    area = box.select("fid", rectangle("a", "b", "c", "d").alias("rings"))
    got = rasters.danger_series(spark, path, "2020-06-02", "2020-06-03", rasters.blocks_of_area(area, grid, 25))
    got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters: [isnotnull(date" in plan
    want = {(d, r, c) for d in (2, 3) for r in range(75, 100) for c in range(25, 50)}
    assert {(x["date"].day, x["row"], x["col"]) for x in got.collect()} == want
    assert all(x["value"] == x["row"] * 1000 + x["col"] for x in got.collect())


def test_burnt_preparation(spark):
    raw = spark.createDataFrame([("2021-08-16 10:00", "12.5"), ("2020/07/01", "x"), ("soon", None)], "FireDate string, AREA_HA string")
    got = [tuple(r) for r in burnt.prepare_burnt(raw).select("fire_date", "fire_year", "area_ha").collect()]
    assert got == [(dt.date(2021, 8, 16), 2021, 12.5), (dt.date(2020, 7, 1), 2020, None), (None, None, None)]
    with pytest.warns(UserWarning, match="the data covers"):
        assert burnt.load_burnt(raw, (2006, 2021)).count() == 2
    ends = spark.createDataFrame([("2021-08-16", "2021-08-01")], "FIREDATE string, FINALDATE string")
    r = burnt.fire_span(ends).first()
    assert r["fire_start"] == r["fire_end"] == dt.date(2021, 8, 16)


def test_class_column_is_found_by_pattern():
    assert landcover.class_column(["id", "code_18"]) == "code_18"
    with pytest.raises(UnknownName):
        landcover.class_column(["code_12", "code_18"])


def test_clear_cut_decoding(spark):
    df = spark.createDataFrame([(0, 0, 21032), (0, 1, 0), (0, 2, 18365)], "row int, col int, code int")
    got = [(r["cut_year"], r["cut_doy"]) for r in clearcut.decode_cuts(df).orderBy("col").collect()]
    assert got == [(2021, 32), (None, None), (2018, 365)]
    with pytest.warns(UserWarning, match="perimeters"):
        assert clearcut.clear_cuts(df).count() == 2


def test_tiles(spark):
    got = {r["tile"] for r in rasters.tiles_of_box(spark, (5.5, 42.5, 6.5, 44.0)).collect()}
    assert got == {"N42E003", "N42E006"}
    df = spark.createDataFrame([(-0.5, -0.5)], "lon double, lat double")
    assert rasters.with_degree_tile(df, "lon", "lat", 1).first()["tile"] == "S01W001"


def test_tiled_write_prunes(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(id % 40 as double) as lon", "cast(id % 30 as double) as lat")
    rasters.write_tiled(rasters.with_degree_tile(df, "lon", "lat"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1000
    plan = back.filter("tile = 'N03E003'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile" in plan


def test_nbr_and_scene_choice(spark):
    rows = [(s, 1, 0, c, 0.5 + 0.1 * s, 0.2) for s in (1, 2, 9) for c in range(10) if not (s == 2 and c < 2)]
    bands = spark.createDataFrame(rows, "scene int, tile int, row int, col int, nir double, swir double")
    ratio = scenes.nbr(bands)
    change = scenes.dnbr(ratio.filter("scene < 9"), ratio.filter("scene = 9"))
    burn = spark.createDataFrame([(0, 0)], "row int, col int")
    got = scenes.rank_pre_scenes(change, burn, 10).collect()
    assert [r["scene"] for r in got] == [1]
    both = {r["scene"]: r["rank"] for r in scenes.rank_pre_scenes(change, burn, 10, min_coverage=0.5).collect()}
    assert both == {2: 1, 1: 2}


def test_lidar_contract(spark):
    with pytest.raises(UnknownName):
        lidar.select_metrics(["Nope"])
    assert len(lidar.select_metrics("all", True)) == 175
    lidar.check_bands(lidar.select_metrics("all", True))
    with pytest.raises(UnknownName):
        lidar.check_bands(["Height"])
    df = spark.createDataFrame([(0, 0, -1.0), (0, 1, 2.0)], "row int, col int, CBH double")
    assert [r["CBH"] for r in lidar.clean_metrics(df, ["CBH"]).orderBy("col").collect()] == [None, 2.0]
    with pytest.warns(UserWarning, match="return number"):
        d = lidar.density(df.drop("CBH"), ["row"], 1.0).first()
    assert d["pulses_per_m2"] == 2 and d["below_spec"]


def test_window_pairs_are_counted_once(spark):
    w = spark.createDataFrame([("a", 0.0, 0.0, 900.0, 900.0, 2021)], "name string, xmin double, ymin double, xmax double, ymax double, flight_year int")
    f = spark.createDataFrame([(1, 2022, 100.0, 100.0, 800.0, 800.0), (2, 2010, 950.0, 0.0, 990.0, 50.0)],
                              "fire_id int, fire_year int, xmin double, ymin double, xmax double, ymax double")
    r = lidar.fire_check(w, f, width=100.0).first()
    assert r["n_fires"] == 1 and r["burnt_after_flight"]


def test_outlines_and_not_their_boxes_meet_windows(spark):
    def diamond(x, y, h):
        return [[(x, y + h), (x + h, y), (x, y - h), (x - h, y)]]

    w = spark.createDataFrame([("corner", 80.0, 80.0, 120.0, 120.0, 2021), ("middle", 40.0, 40.0, 60.0, 60.0, 2021), ("edge", 60.0, 60.0, 90.0, 90.0, 2021),
                               ("around", -500.0, -500.0, 500.0, 500.0, 2021), ("beside", 100.0, 0.0, 140.0, 100.0, 2021)],
                              "name string, xmin double, ymin double, xmax double, ymax double, flight_year int")
    f = spark.createDataFrame([(1, 2022, 0.0, 0.0, 100.0, 100.0, diamond(50.0, 50.0, 50.0))], "fire_id int, fire_year int, xmin double, ymin double, "
                              "xmax double, ymax double, rings array<array<struct<x:double,y:double>>>")
    assert {r["name"] for r in lidar.fire_check(w, f, width=50.0).collect()} == {"middle", "edge", "around"}


def test_manifest_resumes(spark, tmp_path):
    idx = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0), ("c", 9.0, 9.0, 10.0, 10.0)],
                                "name string, xmin double, ymin double, xmax double, ymax double")
    path = str(tmp_path / "m")
    lidar.append_manifest(spark.createDataFrame([("a", "written", 5, 1.0, "p", None)],
                          "name string, status string, points int, seconds double, path string, error string"), path)
    plan = lidar.batch_plan(idx, spark.read.parquet(path), (0, 0, 5, 5))
    assert {r["name"]: r["status"] for r in plan.collect()} == {"a": "done", "b": "todo", "c": "outside"}
    assert lidar.require_tiles(plan).count() == 1


def test_population_total_is_kept(spark, grid_of):
    df, grid = grid_of(np.random.default_rng(0).integers(0, 9, (10, 10)).astype(float), name="pop")
    target = GridSpec(-10, 260, 40, 7, 7)
    after = rasters.population(df, grid, target)
    assert rasters.population_drift(df, after).first()["drift_pct"] == pytest.approx(0)


def cells(spark, codes):
    pdf = pd.DataFrame({"row": np.zeros(len(codes), dtype="int32"), "col": np.arange(len(codes), dtype="int32"), "class": codes})
    return spark.createDataFrame(pdf)


def test_unknown_class_is_null_and_weights_are_checked(spark):
    look = lookup.builtin_lookup(spark, "worldcover")
    got = [r["burnable"] for r in fuel.burnable(cells(spark, ["20", "80", "999", None]), look).orderBy("col").collect()]
    assert got == [1, 0, None, None]
    with pytest.raises(BadWeights):
        fuel.weights_table(spark, {"lava": 1.0})
    with pytest.raises(BadWeights):
        fuel.availability(cells(spark, ["20"]), look, fuel.weights_table(spark).filter("fuel_type <> 'shrubland'"))


def test_merge_is_idempotent_and_hierarchy_follows_rank(spark):
    p, s = cells(spark, ["10", None, None]), cells(spark, ["311", "312", None])
    once = fuel.merge_classes(p, s, "a", "b").orderBy("col").collect()
    assert [(r["class"], r["source"]) for r in once] == [("10", "a"), ("312", "b"), (None, None)]
    again = fuel.merge_classes(fuel.merge_classes(p, s, "a", "b"), s, "a", "b").orderBy("col").collect()
    assert [r["class"] for r in again] == [r["class"] for r in once] and again[0]["source"] == "a"
    assert fuel.source_order("bdforet_v2", "clc_2018") and not fuel.source_order("clc_2018", "bdforet_v2")
    assert fuel.source_order("custom", "bdforet_v2")


def test_fuel_source_chain(spark, grid_of):
    grid = GridSpec(0, 25, 25, 1, 3)
    a = fuel.FuelSource.from_cells(cells(spark, ["10", None, None]), grid, "worldcover_2021", lookup.builtin_lookup(spark, "worldcover"), vintage=2021)
    b = fuel.FuelSource.from_cells(cells(spark, ["311", "312", None]), grid, "clc_2018", lookup.builtin_lookup(spark, "clc"), vintage=2018)
    m = b.merge(a)
    assert m.kind == "worldcover_2021+clc_2018" and m.vintages == {"worldcover_2021": 2021, "clc_2018": 2018}
    assert [s["dataset"] for s in m.prov.sources] == ["worldcover_2021", "clc_2018"]
    h = cells(spark, ["x"] * 3).select("row", "col", F.lit(2.0).alias("Height"))
    full = m.attach(h, grid, {"Height": "m"}).attach_class(cells(spark, ["q", "q", None]), grid, "other")
    assert full.registers == ["categorical", "continuous"] and "other" in full.categorical().columns
    assert full.metric("Height").count() == 3
    with pytest.raises(EmberError):
        full.attach(h, grid, {"Height": "m"})
    with pytest.raises(UnknownName):
        full.metric("CBH")


def test_provenance_merge_and_vintage(spark):
    a = Provenance().source("clc_2018", vintage=2018, licence="CC-BY").step("x", {"a": 1, "b": None})
    b = Provenance().source("bdforet_v2", vintage=2014, licence="CC-BY-NC").source("clc_2018", vintage=2018).step("y")
    m = a.merge(b)
    assert [s["dataset"] for s in m.sources] == ["clc_2018", "bdforet_v2"] and m.vintage() == 2014
    assert [r["fun"] for r in m.steps_df(spark).orderBy("seq").collect()] == ["x", "y"]
    nc = {r["dataset"]: r["non_commercial"] for r in provenance.licences(m.sources_df(spark)).collect()}
    assert nc == {"clc_2018": False, "bdforet_v2": True}
    runs = m.sources_df(spark).withColumn("run", F.lit("r"))
    assert provenance.resolve_vintage(runs, "run").first()["vintage"] == 2014


def test_stack_round_trip(spark, tmp_path, grid_of):
    df, grid = grid_of(np.arange(9.0).reshape(3, 3))
    fine = GridSpec(0, 75, 12.5, 6, 6)
    stack = {"a": Layer(df, grid, role="danger", units="x", prov=Provenance().source("s", vintage=2020).step("f")),
             "b": Layer(df, fine)}
    stack_io.save_stack(stack, str(tmp_path / "s"))
    back = stack_io.read_stack(spark, str(tmp_path / "s"))
    assert back["a"].grid == grid and back["b"].grid == fine and back["a"].role == "danger"
    assert back["a"].prov == stack["a"].prov
    assert sorted(map(tuple, back["a"].df.collect())) == sorted(map(tuple, df.collect()))
    stack_io.write_provenance(spark, back["a"].prov, "run1", str(tmp_path / "p"))
    stack_io.write_provenance(spark, back["a"].prov, "run2", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/sources")).count() == 2
    spark.createDataFrame([(dt.date(2020, 1, k + 1), 0, k, float(k)) for k in range(5)], "date date, row int, col int, value double").write.parquet(str(tmp_path / "d"))
    assert rasters.danger_series(spark, str(tmp_path / "d"), "2020-01-02", "2020-01-03").count() == 2
