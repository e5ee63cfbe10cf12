import datetime as dt

import numpy as np
import pandas as pd
import pytest

from emberline.errors import BadWeather, UnknownName
from emberline.functions import fwi as eq
from emberline.operators import fwi

# Published five-day check: temperature, humidity, wind, rain, then FFMC DMC DC ISI BUI FWI.
PUBLISHED = [
    (17, 42, 25, 0, 87.7, 8.5, 19.0, 10.9, 8.5, 10.1),
    (20, 21, 25, 2.4, 86.2, 10.4, 23.6, 8.8, 10.4, 9.3),
    (8.5, 40, 17, 0, 87.0, 11.8, 26.1, 6.5, 11.7, 7.6),
    (6.5, 25, 6, 0, 88.8, 13.2, 28.2, 4.9, 13.1, 6.2),
    (13, 34, 24, 0, 89.1, 15.4, 31.5, 12.6, 15.3, 14.8),
]


def weather(spark, rows, start=dt.date(2020, 4, 13), sid=1, lat=46.0):
    out = []
    for k, r in enumerate(rows):
        d = start + dt.timedelta(days=k)
        out.append((sid, lat, d.year, d.month, d.day, *[None if v is None else float(v) for v in r[:4]]))
    return spark.createDataFrame(out, "id long, LAT double, yr int, mon int, day int, temp double, rh double, ws double, prec double")


def test_published_days(spark):
    got = fwi.fwi_series(weather(spark, PUBLISHED), ["id"]).orderBy("day").toPandas()
    want = np.array([r[4:] for r in PUBLISHED])
    np.testing.assert_allclose(got[fwi.CODES[:6]].to_numpy(), want, atol=0.051)


def test_unknown_day_is_null_and_codes_wait(spark):
    gap = [PUBLISHED[0], (None, 40, 10, 0), PUBLISHED[1]]
    got = fwi.fwi_series(weather(spark, gap), ["id"]).orderBy("day").toPandas()
    assert got.loc[1, fwi.CODES].isna().all()
    assert got.loc[2, "ffmc"] == pytest.approx(86.2, abs=0.051)


def test_many_stations_and_small_batches_agree_with_one_by_one(spark):
    rng = np.random.default_rng(1)
    frames, want = [], {}
    for sid in range(7):
        n = int(rng.integers(3, 30))
        rows = [(rng.uniform(-5, 35), rng.uniform(5, 100), rng.uniform(0, 60), rng.choice([0, 0, 1, 8, 30])) for _ in range(n)]
        frames.append(weather(spark, rows, dt.date(2021, 1, 20), sid, lat=-40 + 14.0 * sid))
        f, d, c = np.array([85.0]), np.array([6.0]), np.array([15.0])
        for k, r in enumerate(rows):
            day = dt.date(2021, 1, 20) + dt.timedelta(days=k)
            res = eq.day(f, d, c, *[np.array([float(v)]) for v in r], np.array([day.month]), np.array([-40 + 14.0 * sid]))
            f, d, c = res[:3]
            want[sid, day] = [v[0] for v in res]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = fwi.fwi_series(both, ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    for r in got:
        np.testing.assert_allclose([r[c] for c in fwi.CODES], want[r["id"], dt.date(r["yr"], r["mon"], r["day"])], rtol=1e-12)


def test_annual_reset_restarts_codes(spark):
    days = weather(spark, PUBLISHED * 2, dt.date(2020, 12, 28))
    got = fwi.fwi_series(days, ["id"], reset="annual", reset_month=1).orderBy("yr", "mon", "day").toPandas()
    assert got.loc[4, "dmc"] < got.loc[3, "dmc"] + 5
    fresh = fwi.fwi_series(weather(spark, (PUBLISHED * 2)[4:], dt.date(2021, 1, 1)), ["id"]).orderBy("day").toPandas()
    np.testing.assert_allclose(got.loc[4:, "fwi"].to_numpy(), fresh["fwi"].to_numpy())


def test_latitude_bands():
    m = np.full(5, 7)
    le, lf = eq.day_factors(np.array([46.0, 30.0, 15.0, 0.0, -35.0]), m)
    assert le.tolist() == [12.4, 12.4, 10.1, 9.0, 6.5] and lf.tolist() == [6.4, 6.4, 1.4, 1.4, -1.6]
    le, _ = eq.day_factors(np.array([0.0]), np.array([7]), lat_adjust=False)
    assert le[0] == 12.4


def test_spatial_mean_carry_equals_series_for_one_cell(spark):
    w = weather(spark, PUBLISHED)
    dates = [dt.date(2020, 4, 13) + dt.timedelta(days=k) for k in range(5)]
    a = fwi.fwi_by_spatial_mean(w, dates).orderBy("day").toPandas()
    b = fwi.fwi_series(w, ["id"]).orderBy("day").toPandas()
    np.testing.assert_allclose(a["fwi"], b["fwi"])


def test_column_and_range_guards(spark):
    w = weather(spark, PUBLISHED)
    with pytest.raises(BadWeather):
        fwi.fwi_series(w.drop("ws"), ["id"])
    with pytest.raises(UnknownName):
        fwi.fwi_series(w, ["id"], out=["nope"])
    with pytest.raises(BadWeather):
        fwi.check_ranges(w.selectExpr("temp", "120.0 as rh", "ws", "prec"))
    slow = spark.range(40).selectExpr("20.0 as temp", "40.0 as rh", "5.0 as ws", "0.0 as prec")
    with pytest.warns(UserWarning, match="m/s"):
        fwi.check_ranges(slow)


def test_assemble_puts_north_west_first(spark):
    pdf = pd.DataFrame([(44.0, 6.0, 1.0), (44.0, 7.0, 2.0), (43.0, 6.0, 3.0)], columns=["lat", "long", "v"])
    df = spark.createDataFrame(pdf).selectExpr("*", "2020 as yr", "7 as mon", "1 as day")
    got = {(r["row"], r["col"]): r["value"] for r in fwi.assemble(df, "v").collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0}
    spec = fwi.lattice_spec(df)
    assert (spec.nrow, spec.ncol, spec.res) == (2, 2, 1.0)
    with pytest.raises(BadWeather):
        fwi.lattice_spec(df.unionByName(df.limit(1).selectExpr("43.7 as lat", "6.3 as long", "v", "yr", "mon", "day")))


def test_one_station_by_arrays_agrees_with_day_by_day():
    rng = np.random.default_rng(3)
    for n, odd in ((0, []), (3, []), (400, []), (400, [(0, np.nan), (0, 2e4), (1, -1.0), (2, -3.0), (3, np.inf), (4, np.nan)]), (60, [(2, 1.5e4)])):
        days = [rng.integers(-60, 350, n) / 10, rng.integers(0, 101, n) * 1.0, rng.integers(0, 60, n) * 1.0, rng.choice([0.0, 0.5, 1.5, 1.6, 2.9, 45.0], n),
                rng.choice([46.0, 20.0, -20.0, -31.0], n)]
        for j, v in odd:
            days[j][rng.integers(0, n)] = v
        t, h, w, p, lat = days
        month = rng.integers(1, 13, n)
        codes, want = (85.0, 6.0, 15.0), []
        for x in zip(t.tolist(), h.tolist(), w.tolist(), p.tolist(), month.tolist(), lat.tolist(), strict=True):
            got = eq.day_of_one(*codes, *x)
            codes = codes if got is None else got[:3]
            want.append((np.nan,) * 7 if got is None else got)
        got, last = eq.days_of_one((85.0, 6.0, 15.0), t, h, w, p, month, lat)
        np.testing.assert_allclose(got, np.array(want).reshape(-1, 7), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(last, codes, rtol=1e-9)


def test_a_long_series_is_not_computed_day_by_day(monkeypatch):
    from emberline.streaming.weather_stream import StationCodes

    class Handle:
        def getValueState(self, *a):  # noqa: N802
            return self

        def exists(self):
            return False

        def update(self, value):
            self.value = value

    handle, days = Handle(), 500
    codes = StationCodes((85.0, 6.0, 15.0), True, None)
    codes.init(handle)
    first = dt.date(2020, 1, 1)
    rows = pd.DataFrame({"id": 7, "date": [first + dt.timedelta(days=k) for k in range(days)], "day": (first - dt.date(1970, 1, 1)).days + np.arange(days),
                         "lat": 46.0, "temp": 20.0, "rh": 40.0, "ws": 10.0, "prec": [4.0 * (k % 9 == 0) for k in range(days)]})
    calls, one = [], eq.day_of_one
    monkeypatch.setattr(eq, "day_of_one", lambda *a: calls.append(a) or one(*a))
    (out,) = codes.handleInputRows((7,), iter([rows]), None)
    assert len(out) == days and out["fwi"].notna().all() and handle.value[3] == first + dt.timedelta(days=days - 1)
    assert not calls
