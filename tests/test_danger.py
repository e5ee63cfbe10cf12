import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from emberline.errors import BadPeriod, BadRange, DegenerateSample, EmberError, EmptyReference, EmptyResult, UnknownName, VintageRequired
from emberline.grid import GridSpec
from emberline.operators import climatology, directional, profile, proximity, validate, zonal
from emberline.operators.raster import rectangle
from emberline.streaming import weather_stream
from pyspark.sql import functions as F


def series(spark, values, start=dt.date(2020, 5, 1), **more):
    days = [start + dt.timedelta(days=k) for k in range(len(values))]
    return spark.createDataFrame(pd.DataFrame({"date": days, "value": values, "cell": 1, **more})).withColumn("value", F.nullif("value", F.lit(float("nan"))))


def test_percentile_of_an_ordered_series_is_its_rank(spark):
    got = climatology.percentile_of_series(series(spark, [1.0, 2, 3, 4, 5]), "value", "date", ["cell"]).orderBy("date")
    assert [r["percentile"] for r in got.collect()] == [20, 40, 60, 80, 100]


def test_dates_outside_the_reference_are_ranked_but_not_counted(spark):
    df = series(spark, [1.0, 2, np.nan, 4, 3, 9], dt.date(2020, 10, 29))
    got = climatology.percentile_of_series(df, "value", "date", ["cell"]).orderBy("date")
    assert [r["percentile"] for r in got.collect()] == [50, 100, None, 100, 100, 100]


def test_zone_pool(spark):
    df = series(spark, [1.0, 2, 3, 4], z=[1.0, 1, 2, 2]).withColumn("z", F.when(F.col("value") != 4, F.col("z")))
    got = climatology.percentile_of_zone(df, "value", "date", "z").orderBy("date")
    assert [r["percentile"] for r in got.collect()] == [50, 100, 100, None]


def test_period_reading():
    assert climatology.period_bounds((2001, 2003)) == (dt.date(2001, 1, 1), dt.date(2003, 12, 31))
    for bad in ((1,), ("x", "y")):
        with pytest.raises(BadPeriod):
            climatology.period_bounds(bad)
    with pytest.raises(BadPeriod):
        climatology.in_reference("date", None, ("11-01", "03-31"))


def test_reference_checks(spark):
    df = series(spark, [1.0] * 5)
    with pytest.warns(UserWarning, match="years"):
        climatology.check_reference(df, "date")
    with pytest.raises(EmptyReference):
        climatology.check_reference(df, "date", (1990, 1991))


def test_thresholds_against_direct_arithmetic(spark):
    df = series(spark, list(np.linspace(1, 60, 150)))
    r = climatology.class_thresholds(df, "value", "date").first()
    e = np.quantile(np.linspace(1, 60, 150), 0.98)
    i = math.exp(0.980 * math.log(e) ** 1.546) / 0.289
    inner = [math.log(0.289 * i ** (k / 5)) for k in range(1, 6)]
    want = [round(math.exp(1.013 * x ** 0.647)) if x >= 0 else 0 for x in inner]
    assert [r[f"t{k}"] for k in range(1, 6)] == want and r["extreme"] == pytest.approx(e)
    low = climatology.class_thresholds(series(spark, [0.0] * 10), "value", "date").first()
    assert low["t1"] is None and low["extreme"] == 0


def stations(spark, n, seed=0, side=1000.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "ord": np.arange(n), "x": np.round(rng.random(n) * side), "y": np.round(rng.random(n) * side)})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("side", [1400.0, 60_000.0])
def test_nearest_matches_brute_force(spark, side):
    st, pdf = stations(spark, 60)
    pts, pp = stations(spark, 300, 1, side)
    odd = spark.createDataFrame([(900, None, 5.0), (901, 1.0, None), (902, float("nan"), 1.0)], "id long, x double, y double")
    lost = st.limit(1).select(F.lit(99).cast("long").alias("id"), F.lit(99).cast("long").alias("ord"), F.lit(None).cast("double").alias("x"), "y")
    got = proximity.nearest(pts.select("id", "x", "y").union(odd), st.unionByName(lost)).toPandas().set_index("id")
    assert len(got) == 303 and got.loc[[900, 901, 902], ["station", "d2"]].isna().all(axis=None)
    assert proximity.nearest(odd, st.limit(0)).filter("station is null").count() == 3
    d = (pp.x.to_numpy()[:, None] - pdf.x.to_numpy()) ** 2 + (pp.y.to_numpy()[:, None] - pdf.y.to_numpy()) ** 2
    assert (got.loc[pp.id, "station"].to_numpy() == d.argmin(axis=1)).all()


@pytest.mark.parametrize("layout", ["even", "one town", "one line", "one spot"])
def test_nearest_with_many_blocks_and_parts(spark, monkeypatch, layout):
    monkeypatch.setattr(proximity, "BLOCK_STATIONS", 12)
    monkeypatch.setattr(proximity, "LISTED", 2)
    rng = np.random.default_rng(3)
    at = rng.random((150, 2)) * 1000
    if layout == "one town":
        at[:140] = 400 + at[:140] / 50
    elif layout == "one line":
        at[:, 0] = 7.0
    elif layout == "one spot":
        at[:] = 5.0
    at = np.round(at * 4) / 4
    st = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "ord": rng.permutation(150), "x": at[:, 0], "y": at[:, 1]}))
    where = np.round(np.concatenate([rng.random((400, 2)) * 3000 - 1000, at[:20], rng.random((80, 2)) * 4 + 400]) * 4) / 4
    pts = spark.createDataFrame([(None if k % 7 == 0 else k // 2, float(a), float(b), k) for k, (a, b) in enumerate(where)], "key long, x double, y double, _b long")
    got = proximity.nearest(pts, st).toPandas()
    assert len(got) == len(where) and list(got.columns) == ["key", "x", "y", "_b", "station", "d2"]
    order = {r["id"]: r["ord"] for r in st.collect()}
    for r in got.itertuples():
        d = (r.x - at[:, 0]) ** 2 + (r.y - at[:, 1]) ** 2
        near = np.flatnonzero(d == d.min())
        assert r.d2 == d.min() and r.station == min(near, key=order.get)


def test_nearest_tie_goes_to_the_first(spark):
    st = spark.createDataFrame([(7, 2, 0.0, 0.0), (5, 1, 10.0, 0.0)], "id long, ord long, x double, y double")
    pts = spark.createDataFrame([(1, 5.0, 0.0)], "p long, x double, y double")
    assert proximity.nearest(pts, st).first()["station"] == 5


def test_student_p_values():
    for t, df, p in [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 100000, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01)]:
        assert zonal._t_two_sided(t, df) == pytest.approx(p, rel=2e-3)


def test_rain_gradient_gate(spark):
    up = spark.createDataFrame([(k, 100.0 * k, 1.0 + 0.5 * k + (k % 2) * 0.01) for k in range(8)], "id int, elev_m double, prec double")
    g = zonal.rain_gradient(up)
    assert g["usable"] and g["slope"] == pytest.approx(0.005, rel=0.01)
    assert not zonal.rain_gradient(up.limit(2))["usable"]
    assert not zonal.rain_gradient(up.withColumn("elev_m", F.lit(1.0)))["usable"]


def test_zones_of_flat_ground_and_aspect(spark, grid_of):
    df, _ = grid_of(np.full((4, 4), 7.0))
    assert {r["zone"] for r in zonal.topo_zones(df, "value").collect()} == {1}
    faced = df.withColumn("a", F.when(F.col("col") == 1, 90.0))
    assert {r["zone"] for r in zonal.topo_zones(faced, "value", 1, 4, "a").collect()} == {1, 2}
    with pytest.raises(BadRange):
        zonal.topo_zones(df, "value", 0)


def test_downscaling_moves_temperature_and_clips_rain(spark):
    w = spark.createDataFrame([(1, 43.0, 6.0, 2020, 7, 1, 30.0, 40.0, 10.0, 1.0, 100.0)],
                              "id long, lat double, long double, yr int, mon int, day int, temp double, rh double, ws double, prec double, elev_m double")
    z = spark.createDataFrame([(1, 1, 1100.0, 43.2), (2, 1, 100.0, 43.1)], "zone int, station long, elev_mean double, lat double")
    got = {r["zone"]: r for r in zonal.downscale(w, z, rain_slope=-0.01).collect()}
    assert got[1]["temp"] == 23.5 and got[1]["rh"] > 40 and got[1]["prec"] == 0 and got[1]["lat"] == 43.2
    assert got[2]["rh"] == pytest.approx(40) and got[2]["ws"] == 10
    with pytest.raises(Exception, match="elev_m"):
        zonal.downscale(w.drop("elev_m"), z)
    with pytest.raises(UnknownName):
        zonal.zonal_fwi(zonal.downscale(w, z), dates=[dt.date(1999, 1, 1)])
    st = spark.createDataFrame([(1, 1, 0.0, 0.0)], "id long, ord long, x double, y double")
    with pytest.warns(UserWarning, match="without stations"):
        auto = zonal.downscale_auto(w, z.drop("station").selectExpr("*", "0.0 as x", "0.0 as y"), st, GridSpec(0, 1, 1, 1, 1))
    assert auto.count() == 2


def fires(spark, *boxes):
    df = spark.createDataFrame([(k, 2015 + k, 10.0, *[float(v) for v in b]) for k, b in enumerate(boxes)],
                               "fid int, fire_year int, area_ha double, x0 double, y0 double, x1 double, y1 double")
    return df.withColumn("rings", rectangle("x0", "y0", "x1", "y1"))


def test_validation_of_a_perfect_layer(spark, grid_of):
    a = np.zeros((10, 10))
    a[:5, :5] = 1
    df, grid = grid_of(a, name="risk")
    with pytest.warns(UserWarning, match="vintage"):
        v = validate.validate(df, grid, "risk", fires(spark, (0, 125, 125, 250)), "fid")
    assert v.auc == 1 and v.n_burnt == 25 and v.n_cells == 100
    table = {r["bin"]: r for r in v.classes.collect()}
    assert len(table) == 5 and table[5]["pct_of_burnt"] == 100 and table[3]["cells_total"] == 0 and table[3]["ratio"] is None
    curve = v.roc.toPandas().sort_values("threshold", ascending=False)
    assert curve["tpr"].is_monotonic_increasing and curve.iloc[-1]["fpr"] == 1 and curve.iloc[0]["tpr"] == 0


def test_validation_guards(spark, grid_of):
    df, grid = grid_of(np.ones((10, 10)), name="risk")
    with pytest.raises(DegenerateSample):
        validate.validate(df, grid, "risk", fires(spark, (0, 0, 250, 250)), "fid", 2015)
    with pytest.raises(EmptyResult):
        validate.validate(df, grid, "risk", fires(spark, (900, 900, 950, 950)), "fid", 2015)
    with pytest.raises(EmptyResult):
        validate.validate(df, grid, "risk", fires(spark, (0, 0, 50, 50)), "fid", 2000, 3)
    with pytest.raises(VintageRequired):
        validate.drop_late_fires(fires(spark, (0, 0, 1, 1)), None, 3)


def test_calibration_flags_unreachable_and_constant(spark, grid_of):
    df, grid = grid_of(np.ones((30, 30)), name="v")
    burnt = spark.createDataFrame([(12, 12)], "row int, col int")
    got = {r["radius"]: r for r in validate.calibrate_radius(df, grid, "v", burnt, [50, 100, 900]).collect()}
    assert got[50]["note"] == "unreachable" and got[900]["note"] == "unreachable" and got[100]["note"] == "constant"
    assert not any(r["best"] for r in got.values())


@pytest.mark.parametrize("side,lo,hi", [("north", 315, 45), ("east", 45, 135)])
def test_directional_landscape(spark, grid_of, side, lo, hi):
    a = np.zeros((60, 60))
    a[:29] = 0.9 if side == "north" else 0
    if side == "east":
        a[:, 31:] = 0.9
    df, grid = grid_of(a, res=100.0, name="exposure")
    asset = spark.createDataFrame([(1, 3050.0, 3050.0)], "asset int, x double, y double")
    t = directional.directional(asset, df, grid, segments=[900.0] * 3, interval=5.0).toPandas()
    viable = t[t["viable"]]["bearing"]
    inside = ((viable >= lo) | (viable <= hi)) if lo > hi else viable.between(lo, hi)
    assert len(viable) > 10 and inside.mean() > 0.5
    opposite = (180 if side == "north" else 270)
    assert not t.set_index("bearing").loc[opposite, "viable"]


def test_directional_off_grid_and_guards(spark, grid_of):
    df, grid = grid_of(np.ones((10, 10)), res=100.0, name="exposure")
    asset = spark.createDataFrame([(1, 50.0, 50.0)], "asset int, x double, y double")
    t = directional.directional(asset, df, grid, segments=[300.0, 3000.0], interval=90.0).toPandas().set_index("bearing")
    assert t.loc[90, "frac1"] == 1 and t.loc[90, "pct_missing"] > 0 and pd.isna(t.loc[270, "seg2"]) and not t.loc[270, "viable"]
    with pytest.raises(EmberError):
        directional.directional(asset.withColumn("x", F.lit(-5.0)), df, grid)


def test_bearing_ranges(spark):
    df = spark.createDataFrame([(1, float(b), True) for b in (12, 13, 14, 77)], "asset int, bearing double, viable boolean")
    got = sorted((r["first"], r["last"]) for r in directional.bearing_ranges(df).collect())
    assert got == [(12, 14), (77, 77)]


def test_profile_small_samples(spark):
    df = spark.createDataFrame([("a", float(k), None) for k in range(5)] + [("b", 10.0 + k, None) for k in range(5)], "class string, m double, e double")
    assert profile.explained(df, ["m"]).first()["explained"] > 0.8
    assert profile.separability(df, ["m"], "b", min_cells=3).first()["separability"] == 1
    assert profile.separability(df, ["m"], "b").first()["separability"] is None
    assert {r["n"] for r in profile.summarise(df, ["e"]).collect()} == {0}
    with pytest.raises(UnknownName):
        profile.separability(df, ["m"], "zzz")
    with pytest.raises(UnknownName):
        profile.long_metrics(df, ["nope"])


def days_json(spark, path, rows):
    spark.createDataFrame(rows, "id long, date date, lat double, temp double, rh double, ws double, prec double").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, name):
    schema = "id long, date date, lat double, temp double, rh double, ws double, prec double"
    src = spark.readStream.schema(schema).parquet(f"{path}/in")
    q = weather_stream.codes_stream(src).writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r["id"], r["date"]): r for r in spark.read.parquet(f"{path}/out").collect()}


def test_codes_survive_restarts_and_reject_old_days(spark, tmp_path):
    path = str(tmp_path)
    rows = [(1, dt.date(2020, 4, 13), 46.0, 17.0, 42.0, 25.0, 0.0), (2, dt.date(2020, 4, 13), 46.0, 17.0, 42.0, 25.0, 0.0)]
    days_json(spark, f"{path}/in", rows)
    assert run(spark, path, "a")[1, dt.date(2020, 4, 13)]["fwi"] == pytest.approx(10.1, abs=0.05)
    more = [(1, dt.date(2020, 4, 14), 46.0, 20.0, 21.0, 25.0, 2.4), (2, dt.date(2020, 4, 16), 46.0, 20.0, 21.0, 25.0, 2.4),
            (1, dt.date(2020, 4, 15), 46.0, None, 21.0, 25.0, 2.4), (2, dt.date(2020, 4, 12), 46.0, 20.0, 21.0, 25.0, 2.4)]
    days_json(spark, f"{path}/in", more)
    got = run(spark, path, "a")
    assert got[1, dt.date(2020, 4, 14)]["fwi"] == pytest.approx(9.3, abs=0.06)
    assert got[2, dt.date(2020, 4, 16)]["status"] == "gap"
    assert got[1, dt.date(2020, 4, 15)]["status"] == "unknown" and got[1, dt.date(2020, 4, 15)]["ffmc"] is None
    assert got[2, dt.date(2020, 4, 12)]["status"] == "rejected"


def test_codes_over_several_batches_with_late_days(spark, tmp_path):
    from emberline.functions import fwi as eq

    rng = np.random.default_rng(5)
    want, start = {}, dt.date(2021, 3, 1)
    batches = [[], [], [], []]
    for sid in range(40):
        codes, last = (85.0, 6.0, 15.0), None
        days = np.sort(rng.permutation(60)[:45])
        cuts = np.array_split(days, 4)
        for b, own in enumerate(cuts):
            rows = [(start + dt.timedelta(days=int(d)), float(rng.integers(-5, 35)), float(rng.integers(0, 101)), float(rng.integers(0, 40)), float(rng.choice([0, 0, 3.2]))) for d in own]
            late = [(start + dt.timedelta(days=int(d)), 10.0, 50.0, 5.0, 0.0) for d in (cuts[b - 1][-2:] if b else [])]
            for d, t, h, w, p in rows:
                got = np.array(eq.day(*[np.array([x]) for x in (*codes, t, h, w, p)], np.array([d.month]), np.array([40.0])))[:, 0]
                codes = got[:3]
                want[sid, d] = (got, "gap" if last and (d - last).days > 1 else "ok")
                last = d
            batches[b] += [(sid, d, 40.0, *x) for d, *x in late + rows[::-1]]
    n_late = 0
    for b, rows in enumerate(batches):
        days_json(spark, f"{tmp_path}/in", rows)
        run(spark, str(tmp_path), "several")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == sum(map(len, batches))
    for r in out:
        if r["status"] == "rejected":
            n_late += 1
            assert r["fwi"] is None
        else:
            codes, status = want[r["id"], r["date"]]
            assert r["status"] == status
            np.testing.assert_allclose([r[c] for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr")], codes, rtol=1e-9)
    assert n_late == 40 * 3 * 2


def test_one_stations_equations_equal_the_arrays():
    from emberline.functions import fwi as eq

    rng = np.random.default_rng(2)
    n = 2000
    args = [rng.uniform(0, 101, n), rng.uniform(0, 200, n), rng.uniform(0, 900, n), rng.uniform(-20, 45, n), rng.uniform(0, 100, n), rng.uniform(0, 90, n),
            rng.choice([0, 0.3, 1.6, 9.0, 80.0], n), rng.integers(1, 13, n), rng.uniform(-90, 90, n)]
    want = np.array(eq.day(*args))
    for k in range(n):
        one = eq.day_of_one(*[a[k].item() for a in args])
        assert one == pytest.approx(want[:, k].tolist(), rel=1e-9)
    assert eq.day_of_one(85, 6, 15, float("nan"), 40, 5, 0, 6, 45) is None and eq.day_of_one(85, 6, 15, 20, -1, 5, 0, 6, 45) is None


def test_late_hours_are_dropped(spark, tmp_path):
    schema = "id long, ts timestamp, temp double, rh double, ws double, prec double"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = weather_stream.daily_stream(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r["date"]: r["prec"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    start = dt.datetime(2021, 8, 15)
    land([(1, start + dt.timedelta(hours=h), 20.0, 50.0, 5.0, 1.0) for h in range(60)])
    assert go() == {dt.date(2021, 8, 15): 13.0, dt.date(2021, 8, 16): 24.0}
    land([(1, start + dt.timedelta(hours=20), 20.0, 50.0, 5.0, 100.0)] + [(1, start + dt.timedelta(hours=h), 20.0, 50.0, 5.0, 1.0) for h in range(60, 90)])
    assert go()[dt.date(2021, 8, 16)] == 24.0


def test_upsampling_is_reported():
    fine, coarse = GridSpec(0, 100, 10, 10, 10), GridSpec(0, 100, 25, 4, 4)
    assert profile.upsampling_notes(fine, fine) == [] and len(profile.upsampling_notes(coarse, fine)) == 1
    with pytest.warns(UserWarning, match="about 6.2 cells"):
        assert len(profile.upsampling_notes(fine, coarse)) == 2
    assert profile.default_metrics(["x", "Cover"]) == ["Cover"] and profile.default_metrics(["x"]) == ["x"]
