"""Weather as a stream: hourly rows to daily records, daily records to moisture codes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.functions import fwi as eq
from emberline.functions.constants import FWI_START


def daily_stream(hourly: DataFrame, hour: int = 12, late: str = "2 hours") -> DataFrame:
    """Daily noon record with the rain of the 24 hours ending there; rows later than the watermark are dropped.

    The day's span starts one hour after the previous record, so one shifted tumbling
    window per day does the work of a sliding one.
    """
    day = F.window("ts", "24 hours", "24 hours", f"{hour + 1} hours")
    at = F.hour("ts") == hour
    pick = F.max(F.when(at, F.struct("ts", "temp", "rh", "ws")))
    agg = hourly.withWatermark("ts", late).groupBy("id", day.alias("w")).agg(
        F.coalesce(F.sum("prec"), F.lit(0.0)).alias("prec"), pick.alias("n"))
    return agg.filter(F.col("n").isNotNull()).select(
        "id", F.to_date("n.ts").alias("date"), F.col("n.temp").alias("temp"), F.col("n.rh").alias("rh"),
        F.col("n.ws").alias("ws"), "prec")


STATE_SCHEMA = "ffmc double, dmc double, dc double, last date"
_CODES = ["ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr"]
#: Numbers of the statuses on their way back from Python, in which dates are days since 1970 too.
STATUS = ["ok", "gap", "unknown", "rejected"]
_OK, _GAP, _UNKNOWN, _REJECTED = range(4)
_EPOCH = dt.date(1970, 1, 1)
_OUT_SCHEMA = "id long, day int, ffmc double, dmc double, dc double, isi double, bui double, fwi double, dsr double, status int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StationCodes(StatefulProcessor):
    """A station's three moisture codes and its last day, advanced day by day."""

    def __init__(self, first: tuple[float, float, float], lat_adjust: bool, forget_ms: int | None) -> None:
        self.first, self.lat_adjust, self.forget_ms = first, lat_adjust, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("codes", STATE_SCHEMA, self.forget_ms)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        codes, last = (held[:3], (held[3] - _EPOCH).days) if held else (self.first, None)
        parts = list(rows)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        day = pdf["day"].to_numpy("int64")
        order = np.argsort(day, kind="stable")
        day = day[order]
        # A day that is not after the one before it, or not after the last one seen, is rejected before any step.
        before = np.r_[day[0] if last is None else last, day[:-1]]
        late = np.r_[False if last is None else day[0] <= last, day[1:] == day[:-1]]
        if last is not None:
            late |= day <= last
            before = np.maximum(before, last)
        status = np.where(late, _REJECTED, np.where(day - before > 1, _GAP, _OK))
        new = np.flatnonzero(~late)
        temp, rh, ws, prec, lat = (pdf[c].to_numpy(dtype="float64", na_value=np.nan)[order[new]] for c in ("temp", "rh", "ws", "prec", "lat"))
        month = day[new].astype("datetime64[D]").astype("datetime64[M]").astype("int64") % 12 + 1
        got, codes = eq.days_of_one(codes, temp, rh, ws, prec, month, lat, self.lat_adjust)
        status[new[np.isnan(got[:, 0])]] = _UNKNOWN
        self.state.update((*codes, _EPOCH + dt.timedelta(days=int(max(day[-1], before[-1])))))
        out = np.full((len(day), 7), np.nan)
        out[new] = got
        yield pd.DataFrame({"id": np.full(len(day), key[0]), "day": day.astype("int32"), **dict(zip(_CODES, out.T, strict=True)), "status": status.astype("int32")})

    def close(self) -> None:
        pass


def codes_stream(daily: DataFrame, init: dict[str, float] | None = None, lat_adjust: bool = True,
                 forget_ms: int | None = None) -> DataFrame:
    """Running codes per station with state kept by Spark: three numbers and a date for each.

    A day at or before the last one seen is rejected, a skipped day is flagged as a
    gap, and a day with unknown input leaves the codes as they were.  Columns needed:
    ``id, date, lat, temp, rh, ws, prec``.  Rows without a date are left out.

    ``forget_ms`` drops the state of a station that has sent nothing for so long; it then starts anew.  State is kept in
    RocksDB, which this kind of operator needs, so the session is set to that where it still has the built-in default.
    """
    start = {**FWI_START, **(init or {})}
    spark, key = daily.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key):
        spark.conf.set(key, _ROCKS)
    rows = daily.filter(F.col("date").isNotNull()).select(
        F.col("id").cast("long").alias("id"), F.unix_date(F.col("date").cast("date")).alias("day"), *[F.col(c).cast("double").alias(c) for c in ("lat", "temp", "rh", "ws", "prec")])
    codes = StationCodes((start["ffmc"], start["dmc"], start["dc"]), lat_adjust, forget_ms)
    out = rows.groupBy("id").transformWithStateInPandas(codes, _OUT_SCHEMA, "Append", "None" if forget_ms is None else "ProcessingTime")
    names = F.array(*[F.lit(s) for s in STATUS])
    return out.select("id", F.date_from_unix_date("day").alias("date"), *_CODES, F.get(names, F.col("status")).alias("status"))
