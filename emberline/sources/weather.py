"""Hourly weather as landed JSON, turned into one record per station and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOURLY = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation"]
HOURLY_SCHEMA = T.StructType([
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))] +
        [T.StructField(c, T.ArrayType(T.DoubleType())) for c in _HOURLY])),
])


def read_hourly_json(spark: SparkSession, path: str, stations: list[int]) -> tuple[DataFrame, DataFrame]:
    """Hourly rows and the served-cell table of one response file.

    A file holds one object, or an array with one object per requested point, each of which is a row as it is read.
    Points are matched by position; a task that finds one too many, or one without a series, fails.
    """
    asked = spark.createDataFrame(list(enumerate(stations)), "pos long, id long")
    # One response is one file and so one partition: the low bits of the number are the place in it.
    series = spark.read.schema(HOURLY_SCHEMA).option("multiLine", True).json(path).withColumn(
        "pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    both = series.withColumn("_got", F.lit(True)).join(asked, "pos", "full")
    wrong = F.col("_got").isNull() | F.col("id").isNull()
    refused = F.raise_error(F.lit(f"BadWeather: asked for {len(stations)} points, the response has another number"))
    named = both.withColumn("id", F.when(wrong, refused.cast("long")).otherwise(F.col("id")))
    return _opened(named)


def read_hourly_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_hourly_json`, of landed lines: a point with its ``id`` on each, so that files are read in parts."""
    return _opened(spark.read.schema(T.StructType([T.StructField("id", T.LongType()), *HOURLY_SCHEMA])).json(path))


def _opened(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    served = named.select("id", F.col("latitude").alias("cell_lat"), F.col("longitude").alias("cell_long"),
                          F.col("elevation").alias("elev_m"))
    h = F.col("hourly")
    rows = named.select("id", F.inline(F.arrays_zip(h["time"].alias("time"), *[h[c].alias(c) for c in _HOURLY])))
    hourly = rows.select(
        "id", F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm").alias("ts"), F.col("temperature_2m").alias("temp"),
        F.col("relative_humidity_2m").alias("rh"), F.col("wind_speed_10m").alias("ws"), F.col("precipitation").alias("prec"))
    return hourly, served


def hourly_lines(hourly: DataFrame, served: DataFrame) -> DataFrame:
    """Hourly rows and served cells as one response object a station, for landing as lines."""
    by_time = F.array_sort(F.collect_list(F.struct("ts", "temp", "rh", "ws", "prec")))
    names = dict(zip(_HOURLY, ("temp", "rh", "ws", "prec"), strict=True))
    series = hourly.groupBy("id").agg(by_time.alias("h")).select("id", F.struct(
        F.transform("h", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[F.col(f"h.{c}").alias(name) for name, c in names.items()]).alias("hourly"))
    return series.join(served, "id", "left").select(
        "id", F.col("cell_lat").alias("latitude"), F.col("cell_long").alias("longitude"), F.col("elev_m").alias("elevation"), "hourly")


def noon_day(ts, hour: int) -> Column:
    """Date of the daily record an hourly row belongs to: the 24 hours that end at ``hour``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c + F.expr(f"INTERVAL {23 - hour} HOURS"))


def daily_from_hourly(hourly: DataFrame, hour: int = 12, start: str | None = None) -> DataFrame:
    """Station-day records: values at one UTC hour, rain summed over the 24 hours ending there.

    The 24-hour spans of successive days tile the time axis, so each hourly row feeds
    exactly one day and a plain grouped sum replaces a moving window.  Days without a
    row at the hour are absent; ``start`` drops the lead-in day.
    """
    at = F.hour("ts") == hour
    pick = F.max(F.when(at, F.struct("ts", "temp", "rh", "ws")))
    days = hourly.withColumn("date", noon_day("ts", hour)).groupBy("id", "date").agg(
        F.coalesce(F.sum("prec"), F.lit(0.0)).alias("prec"), pick.alias("n")).filter(F.col("n").isNotNull())
    if start is not None:
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
    return days.select("id", "date", F.year("date").alias("yr"), F.month("date").alias("mon"), F.dayofmonth("date").alias("day"),
                       F.col("n.temp").alias("temp"), F.col("n.rh").alias("rh"), F.col("n.ws").alias("ws"), "prec")


def with_served(days: DataFrame, served: DataFrame) -> DataFrame:
    """Attach the served cell and its elevation to every day of a station."""
    return days.join(served, "id", "left")


def union_chunks(*chunks: DataFrame) -> DataFrame:
    """Yearly chunks one after another; columns a chunk lacks are null."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
