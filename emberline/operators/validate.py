"""Scoring a layer against burnt areas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.errors import AllNull, DegenerateSample, EmptyResult, VintageRequired, notice
from emberline.grid import CELL, GridSpec
from emberline.operators.classify import score_bin
from emberline.operators.focal import exposure_sweep
from emberline.operators.rank import auc, quantiles_of_counts, value_counts
from emberline.operators.raster import rasterize
from emberline.operators.windows import default_radii, window_side


def temporal_bins(fires: DataFrame, vintage: int, max_lag: int = 5) -> DataFrame:
    """Fires and burnt hectares by how long after the fuel vintage they burnt: always three rows."""
    lag = F.col("fire_year") - vintage
    bin_ = F.when(lag <= 0, 1).when(lag <= max_lag, 2).when(lag > max_lag, 3)
    area = F.coalesce(F.col("area_ha").cast("double"), F.lit(0.0))
    total = fires.agg(F.sum(area)).scalar()
    label = F.when(F.col("bin") == 1, "<= 0").when(F.col("bin") == 2, f"1 to {max_lag}").otherwise(f"> {max_lag}")
    got = fires.select(bin_.alias("bin"), area.alias("a")).filter("bin is not null").groupBy("bin").agg(
        F.count("*").alias("n_fires"), F.bround(F.sum("a"), 1).alias("area_ha"))
    zero = F.lit(0.0)
    got = fires.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").withColumns(
        {"n_fires": F.coalesce("n_fires", F.lit(0)), "area_ha": F.coalesce("area_ha", zero)})
    return got.select("bin", label.alias("lag_years"), "n_fires", "area_ha",
                      F.when(total > 0, F.bround(100 * F.col("area_ha") / total, 1)).alias("pct_area"))


def drop_late_fires(fires: DataFrame, vintage: int | None, max_lag: int | None) -> DataFrame:
    """Drop fires that burnt too long after the fuel was mapped; unknown years are kept."""
    if max_lag is None:
        return fires
    if vintage is None:
        raise VintageRequired("a lag filter needs the fuel vintage")
    lag = F.col("fire_year") - vintage
    return fires.filter(lag.isNull() | (lag <= max_lag))


def burnt_cells(fires: DataFrame, grid: GridSpec, fid: str, rings: str = "rings") -> DataFrame:
    """Cells whose centre lies in any fire."""
    return rasterize(fires, grid, fid, rings).select(*CELL).distinct()


def score_against(cells: DataFrame, score: str, burnt: DataFrame) -> DataFrame:
    """Scored cells with whether they burnt: one left join, one row per scored cell."""
    flags = burnt.select(*CELL, F.lit(True).alias("_b"))
    return cells.filter(F.col(score).isNotNull()).join(flags, CELL, "left").select(
        *CELL, F.col(score).cast("double").alias("score"), F.coalesce("_b", F.lit(False)).alias("burnt"))


def class_table(scored: DataFrame, breaks: list[float] = (0.2, 0.4, 0.6, 0.8, 1.0), score: str = "score",
                positive: str = "burnt") -> DataFrame:
    """Observed against expected share of burnt cells per risk class, empty classes included."""
    breaks = sorted(breaks)
    lows = [0.0, *breaks[:-1]]
    n = len(breaks)
    counts = scored.groupBy(score_bin(score, breaks).alias("bin")).agg(
        F.count("*").alias("cells"), F.count_if(positive).alias("burnt")).filter("bin is not null")
    frame = scored.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    bounds = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(lows, breaks)])
    w = Window.partitionBy(F.lit(0))
    full = frame.join(counts, "bin", "left").fillna(0, ["cells", "burnt"]).select(
        "bin", F.element_at(bounds, F.col("bin")).alias("b"), "cells", "burnt",
        (F.col("cells") / F.sum("cells").over(w)).alias("ea"), (F.col("burnt") / F.sum("burnt").over(w)).alias("eb"))
    return full.select(
        "bin", F.col("b.lo").alias("lower"), F.col("b.hi").alias("upper"), F.col("cells").alias("cells_total"),
        F.col("burnt").alias("cells_burnt"), F.bround(100 * F.col("ea"), 2).alias("pct_of_area"),
        F.bround(100 * F.col("eb"), 2).alias("pct_of_burnt"),
        F.when(F.col("ea") > 0, F.bround(F.col("eb") / F.col("ea"), 2)).alias("ratio"))


def roc(scored: DataFrame, n_thresholds: int = 200, score: str = "score", positive: str = "burnt") -> DataFrame:
    """True and false positive rates of ``score >= threshold`` at distinct score quantiles.

    Scores are counted once per threshold interval; the rates are running totals over
    the short threshold table.
    """
    n = max(n_thresholds, 2)
    counts = value_counts(scored, score, pos=F.count_if(positive))
    cut = quantiles_of_counts(counts, score, [i / (n - 1) for i in range(n)]).select("q").distinct()
    cuts = cut.agg(F.array_sort(F.collect_list("q")).alias("c")).scalar()
    k = F.aggregate("_c", F.lit(0), lambda acc, x: acc + (x <= F.col(score)).cast("int"))
    binned = counts.withColumn("_c", cuts).select(k.alias("k"), "n", "pos").groupBy("k").agg(
        F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    short = Window.partitionBy(F.lit(0))
    spots = cut.select(F.col("q").alias("threshold"), F.row_number().over(short.orderBy("q")).alias("k"))
    ends = scored.sparkSession.range(1)
    spots = spots.union(ends.select(F.lit(float("-inf")), F.lit(0))).union(ends.select(F.lit(float("inf")), F.lit(2**31 - 1)))
    above = short.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    full = spots.join(binned, "k", "left").fillna(0, ["pos", "neg"])
    return full.select("threshold", (F.sum("pos").over(above) / F.sum("pos").over(short)).alias("tpr"),
                       (F.sum("neg").over(above) / F.sum("neg").over(short)).alias("fpr"))


@dataclass(frozen=True)
class Validation:
    auc: float
    n_cells: int
    n_burnt: int
    roc: DataFrame
    classes: DataFrame
    temporal: DataFrame | None


def validate(cells: DataFrame, grid: GridSpec, score: str, fires: DataFrame, fid: str, vintage: int | None = None,
             max_lag: int | None = None, breaks=(0.2, 0.4, 0.6, 0.8, 1.0), n_thresholds: int = 200) -> Validation:
    """AUC, ROC, class table and temporal bias of a risk layer against fires."""
    kept = drop_late_fires(fires, vintage, max_lag)
    if kept.isEmpty():
        raise EmptyResult("no fire is left after the temporal filter")
    scored = score_against(cells, score, burnt_cells(kept, grid, fid))
    r = auc(scored, "score", "burnt").first()
    if r is None:
        raise AllNull("the layer holds no value")
    if r["n_pos"] == 0:
        raise EmptyResult("no fire overlaps the layer")
    if r["n_neg"] == 0:
        raise DegenerateSample("every cell burnt")
    if vintage is None:
        notice("the fuel vintage is unknown: temporal bias cannot be assessed")
    bins = None if vintage is None else temporal_bins(fires, vintage, max_lag or 5)
    return Validation(r["auc"], r["n_pos"] + r["n_neg"], r["n_pos"], roc(scored, n_thresholds),
                      class_table(scored, list(breaks)), bins)


def calibrate_radius(cells: DataFrame, grid: GridSpec, value: str, burnt: DataFrame, radii: list[float] | None = None,
                     na_rm: bool = False) -> DataFrame:
    """AUC of exposure against burnt cells for a sweep of radii, the best flagged.

    All reachable radii come from one tile pass.  Radii the grid cannot resolve or
    hold keep a row with a note; so do radii whose score is constant.
    """
    radii = sorted(set(radii or default_radii(grid)))

    def fits(r: float) -> bool:
        side = window_side(grid.res, r)
        return grid.res <= r / 3 and side * 2 < grid.nrow and side * 2 < grid.ncol

    ok = [r for r in radii if fits(r)]
    spark = cells.sparkSession
    frame = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(float(r)).alias("radius"), F.lit(r in ok).alias("reachable")) for r in radii])).alias("s")).select("s.*")
    if not ok:
        raise EmptyResult("no radius of the sweep is reachable")
    swept = exposure_sweep(cells, grid, value, ok, na_rm).filter(F.col("exposure").isNotNull())
    flags = burnt.select(*CELL, F.lit(True).alias("_b"))
    scored = swept.join(flags, CELL, "left").select(
        "radius", "exposure", F.coalesce("_b", F.lit(False)).alias("burnt"))
    spread = scored.groupBy("radius").agg((F.min("exposure") == F.max("exposure")).alias("flat"))
    got = auc(scored, "exposure", "burnt", ["radius"]).join(spread, "radius")
    table = frame.join(got, "radius", "left")
    value_ = F.when(~F.col("flat"), F.col("auc"))
    note = (F.when(~F.col("reachable"), "unreachable").when(F.col("n_pos").isNull() | (F.col("n_pos") == 0) | (F.col("n_neg") == 0), "one class")
            .when(F.col("flat"), "constant"))
    table = table.select("radius", "reachable", value_.alias("auc"), "n_pos", note.alias("note"))
    all_ = Window.partitionBy(F.lit(0))
    order = F.when(F.col("auc").isNotNull(), F.struct(-F.col("auc"), F.col("radius")))
    best = F.min_by("radius", order).over(all_)
    scored_radius = F.when(F.col("auc").isNotNull(), F.col("radius"))
    edge = (F.count("auc").over(all_) > 1) & (
        (best == F.min(scored_radius).over(all_)) | (best == F.max(scored_radius).over(all_)))
    return table.select("*", F.coalesce(F.col("radius") == best, F.lit(False)).alias("best"), edge.alias("at_edge"))
