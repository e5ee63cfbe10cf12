"""Daily fire-weather recurrence over many stations, zones or cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberline.errors import BadWeather, UnknownName
from emberline.functions import fwi as eq
from emberline.functions.constants import FWI_START, values_table
from emberline.grid import CELL, GridSpec
from emberline.operators.rank import cumulative
from emberline.session import cut_lineage

CODES = ["ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr"]
NEEDED = ["lat", "yr", "mon", "day", "temp", "rh", "ws", "prec"]


def check_columns(weather: DataFrame, needed: list[str]) -> DataFrame:
    """Weather with lower-case names; a missing column is an error."""
    weather = weather.toDF(*[c.lower() for c in weather.columns])
    missing = [c for c in needed if c not in weather.columns]
    if missing:
        raise BadWeather(f"weather lacks {missing}")
    return weather


def range_report(weather: DataFrame) -> DataFrame:
    """Ranges behind the plausibility rules, with their verdicts, in one pass."""
    bad_rh = F.count_if((F.col("rh") < 0) | (F.col("rh") > 100))
    neg = F.count_if((F.col("ws") < 0) | (F.col("prec") < 0))
    odd = F.count_if(F.abs("temp") > 60)
    return weather.agg(
        F.count("*").alias("n"), bad_rh.alias("bad_rh"), neg.alias("negative"), odd.alias("odd_temp"),
        F.max("ws").alias("max_ws"), ((F.max("ws") < 30) & (F.count("*") >= 30)).alias("wind_unit_suspect"))


def check_ranges(weather: DataFrame) -> None:
    from emberline.errors import notice

    r = range_report(weather).first()
    if r["bad_rh"] or r["negative"]:
        raise BadWeather(f"{r['bad_rh']} humidity values outside 0-100, {r['negative']} rows of negative wind or rain")
    if r["odd_temp"]:
        notice(f"{r['odd_temp']} temperatures beyond 60 degrees")
    if r["wind_unit_suspect"]:
        notice("no wind reaches 30: is it in m/s rather than km/h?")


def season_key(reset_month: int):
    """Year of the season a day belongs to when codes restart each ``reset_month``."""
    return F.col("yr") - (F.col("mon") < reset_month).cast("int")


def fwi_series(
    weather: DataFrame,
    key: list[str],
    init: dict[str, float] | None = None,
    reset: str = "none",
    reset_month: int = 1,
    lat_adjust: bool = True,
    out: list[str] | None = None,
) -> DataFrame:
    """Moisture codes and indices of every key and day.

    Days of one key must be handled in order, but keys are independent: rows are
    numbered within their key, each partition is sorted by that number, and one step
    of all its keys is one array operation.  A partition is streamed batch by batch,
    holding three codes per key and never a whole series.  A day with an unknown
    input gives null and leaves the codes as they were.
    """
    weather = check_columns(weather, NEEDED)
    start = {**FWI_START, **(init or {})}
    out = out or CODES
    unknown = set(out) - set(CODES)
    if unknown:
        raise UnknownName(f"no index {sorted(unknown)}; there are {CODES}")
    group = list(key)
    df = weather
    if reset == "annual":
        df = df.withColumn("_season", season_key(reset_month))
        group.append("_season")
    date = F.make_date("yr", "mon", "day")
    df = df.withColumn("_d", date).withColumn(
        "_k", F.row_number().over(Window.partitionBy(*group).orderBy("_d")))
    drop = [c for c in out if c in df.columns]
    df = df.drop(*drop)
    schema = T.StructType([f for f in df.schema if f.name not in ("_k", "_d", "_season")] +
                          [T.StructField(c, T.DoubleType()) for c in out])
    passed = [f.name for f in schema if f.name not in out]
    first = [start["ffmc"], start["dmc"], start["dc"]]

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = pd.Index([], dtype=object)
        state = np.empty((0, 3))
        for pdf in batches:
            if not len(pdf):
                continue
            names = pd.MultiIndex.from_frame(pdf[group]) if len(group) > 1 else pd.Index(pdf[group[0]])
            codes, uniq = pd.factorize(names)
            at = seen.get_indexer(uniq) if len(seen) else np.full(len(uniq), -1)
            new = at < 0
            if new.any():
                at[new] = len(seen) + np.arange(new.sum())
                seen = uniq[new] if not len(seen) else seen.append(uniq[new])
                state = np.vstack([state, np.tile(first, (int(new.sum()), 1))])
            slot = at[codes]
            cols = {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in ("temp", "rh", "ws", "prec", "lat")}
            month, order = pdf["mon"].to_numpy(), pdf["_k"].to_numpy()
            result = np.empty((len(pdf), len(CODES)))
            edges = np.flatnonzero(np.diff(order)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(pdf)]):
                s = slot[a:b]
                with np.errstate(invalid="ignore"):
                    got = np.stack(eq.day(state[s, 0], state[s, 1], state[s, 2], cols["temp"][a:b], cols["rh"][a:b],
                                          cols["ws"][a:b], cols["prec"][a:b], month[a:b], cols["lat"][a:b], lat_adjust))
                ok = np.isfinite(got).all(axis=0)
                state[s[ok]] = got[:3, ok].T
                got[:, ~ok] = np.nan
                result[a:b] = got.T
            frame = pdf[passed].copy()
            for i, c in enumerate(CODES):
                if c in out:
                    frame[c] = result[:, i]
            yield frame

    return df.drop("_d").sortWithinPartitions("_k", *group).mapInPandas(steps, schema)


def fwi_from_codes(weather: DataFrame, lat_adjust: bool = True) -> DataFrame:
    """One step from given codes: rows carry yesterday's ``f0, p0, c0`` beside the weather of the day."""
    schema = T.StructType([f for f in weather.schema if f.name not in ("f0", "p0", "c0")] +
                          [T.StructField(c, T.DoubleType()) for c in CODES])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in ("f0", "p0", "c0", "temp", "rh", "ws", "prec")]
            with np.errstate(invalid="ignore"):
                got = np.stack(eq.day(*x, pdf["mon"].to_numpy(), pdf["lat"].to_numpy(dtype="float64"), lat_adjust))
            got[:, ~np.isfinite(got).all(axis=0)] = np.nan
            yield pdf.drop(columns=["f0", "p0", "c0"]).assign(**dict(zip(CODES, got)))

    return weather.mapInPandas(step, schema)


def fwi_by_spatial_mean(weather: DataFrame, dates: list, init: dict[str, float] | None = None,
                        lat_adjust: bool = True) -> DataFrame:
    """Gridded variant that carries each day's codes forward as means over the grid.

    Kept for comparison: the per-cell recurrence of :func:`fwi_series` is the default.
    Means of one day feed the next, so days follow one another; each is a distributed
    pass over its own rows that returns three numbers.  The result itself is one pass.
    """
    state = {**FWI_START, **(init or {})}
    codes = ("ffmc", "dmc", "dc")
    weather = cut_lineage(check_columns(weather, NEEDED).withColumn("_d", F.make_date("yr", "mon", "day")))
    carried = []
    for d in sorted(dates):
        carried.append((d, *[float(state[c]) for c in codes]))
        given = {n: F.lit(float(state[c])) for n, c in zip(("f0", "p0", "c0"), codes)}
        day = fwi_from_codes(weather.filter(F.col("_d") == F.lit(d)).withColumns(given), lat_adjust)
        means = day.agg(*[F.avg(c).alias(c) for c in codes]).first()
        state = {c: means[c] if means[c] is not None else state[c] for c in codes}
    start = F.broadcast(values_table(weather.sparkSession, ["_d", "f0", "p0", "c0"], carried))
    return fwi_from_codes(weather.join(start, "_d").drop("_d"), lat_adjust)


def axis_index(df: DataFrame, coord: str, out: str, descending: bool = False) -> DataFrame:
    """Ordinal of each distinct coordinate along its axis, counted without sorting it in one task."""
    distinct = df.select(coord).distinct().withColumn("one", F.lit(1))
    table = cumulative(distinct, coord, ["one"])
    pos = F.col("one_total") - 1 - F.col("one_before") if descending else F.col("one_before")
    return table.select(coord, pos.cast("int").alias(out))


def assemble(series: DataFrame, index: str, lat: str = "lat", long: str = "long", stations: DataFrame | None = None) -> DataFrame:
    """Station values as a dated grid by exact coordinates: north row first, west column first.

    ``stations`` gives the coordinates of the lattice, so that a long recurrence need
    not run again just to list them.  A row whose coordinates are not among them fails
    the task: it has no place on the lattice.
    """
    where = series if stations is None else stations
    rows, cols = axis_index(where, lat, "row", descending=True), axis_index(where, long, "col")
    def placed(axis: str) -> Column:
        lost = F.raise_error(F.concat(F.lit("no place on the lattice for station at "), F.coalesce(F.col(lat).cast("string"), F.lit("null")),
                                      F.lit(", "), F.coalesce(F.col(long).cast("string"), F.lit("null"))))
        return F.coalesce(axis, lost.cast("int")).alias(axis)

    return series.join(rows, lat, "left").join(cols, long, "left").select(
        F.make_date("yr", "mon", "day").alias("date"), *[placed(c) for c in CELL], F.col(index).alias("value"))


def lattice_spec(series: DataFrame, lat: str = "lat", long: str = "long", crs: str = "") -> GridSpec:
    """Grid of a regular station lattice; irregular spacing is an error."""
    got = series.agg(F.min(long), F.max(long), F.min(lat), F.max(lat), F.count_distinct(long), F.count_distinct(lat)).first()
    x0, x1, y0, y1, nx, ny = got
    res = (x1 - x0) / (nx - 1) if nx > 1 else (y1 - y0) / max(ny - 1, 1)
    spec = GridSpec(x0 - res / 2, y1 + res / 2, res, ny, nx, crs)
    col, row = (F.col(long) - x0) / res, (F.lit(y1) - F.col(lat)) / res
    off = series.filter((F.abs(col - F.round(col)) > 1e-6) | (F.abs(row - F.round(row)) > 1e-6))
    if not off.isEmpty():
        raise BadWeather("stations do not lie on a regular lattice")
    return spec
