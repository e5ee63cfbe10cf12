"""Nearest station of each point through an adaptive partition of the plane.

Stations are cut into strips of equal numbers by x and each strip into blocks of equal numbers by y, never more than
``BLOCKS`` of them, so the cuts fit on the driver whatever the number of stations.  Points fall into the same blocks, and
the box of a block's points bounds which blocks of stations can hold a nearest one.  Each block is halved both ways
until few stations are left for a part; a station is on the list of a part unless another is nearer to all of it.

The lists are a table of their own, written once.  A point meets the one list of its part in a plain equi-join, which is
a broadcast where the written table is small and a shuffle that can be split elsewhere, and the nearest of the list is
picked inside the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import cut_lineage, hold

#: Blocks of stations at most, and stations of one on average while there are fewer blocks.
BLOCKS, BLOCK_STATIONS = 4096, 256
#: Stations of a list that halving aims at, and how often a block is halved each way at most.
LISTED, DEEPEST = 8, 8
#: Rounding that bounds allow for, as a part of what they bound.
ROUNDING = 1e-9


def _placed(x: Column, y: Column) -> Column:
    """Both coordinates known and finite."""
    return F.coalesce((F.abs(x) < F.lit(float("inf"))) & (F.abs(y) < F.lit(float("inf"))) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def _above(cuts: Column, v: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= v))


def _cuts(st: DataFrame, n: int) -> tuple[list[float], list[list[float]]]:
    """Cuts of x, and of y in each strip; none for so few stations that they are one block."""
    parts = min(BLOCKS, -(-n // BLOCK_STATIONS))
    strips = math.ceil(math.sqrt(parts))
    if strips <= 1:
        return [], [[]]
    probs = [k / strips for k in range(1, strips)]
    xs = sorted(set(st.agg(F.percentile_approx("_sx", probs, 10_000)).first()[0]))
    by = st.groupBy(_above(F.lit(xs), F.col("_sx")).alias("s")).agg(F.percentile_approx("_sy", probs, 10_000).alias("c"))
    found = {r["s"]: sorted(set(r["c"])) for r in by.collect()}
    return xs, [found.get(k, []) for k in range(len(xs) + 1)]


def _block(xs: list[float], ys: list[list[float]], x: Column, y: Column) -> Column:
    if not xs:
        return F.lit(0)
    strip = _above(F.lit(xs), x)
    own = F.element_at(F.array(*[F.array(*map(F.lit, c)).cast("array<double>") for c in ys]), strip + 1)
    return (strip * (max(map(len, ys)) + 1) + _above(own, y)).cast("int")


def _boxes(df: DataFrame, x: str, y: str) -> pd.DataFrame:
    """Count and box of each block; a row a block, so no more than ``BLOCKS``."""
    rows = df.groupBy("_b").agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).collect()
    return pd.DataFrame([tuple(r) for r in rows], columns=["b", "n", "x0", "x1", "y0", "y1"])


def _between(box: tuple, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the least and the greatest distance from a box (x0, x1, y0, y1) to others; a spot is a box, too."""
    a0, a1, b0, b1 = box
    gap = np.maximum(np.maximum(x0 - a1, a0 - x1), 0) ** 2 + np.maximum(np.maximum(y0 - b1, b0 - y1), 0) ** 2
    far = np.maximum(abs(x1 - a0), abs(a1 - x0)) ** 2 + np.maximum(abs(y1 - b0), abs(b1 - y0)) ** 2
    return gap, far


def _reachable(box: tuple, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Which boxes may hold what is nearest to some point of ``box``."""
    gap, far = _between(box, x0, x1, y0, y1)
    return np.flatnonzero(gap <= far.min() * (1 + ROUNDING))


def _parts(box: tuple[float, float, float, float], depth: int, sx: np.ndarray, sy: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Column, row and listed stations of each of the 4 ** depth parts of a box."""
    x0, x1, y0, y1 = box
    level = [(0, 0, np.arange(len(sx)))]
    for k in range(depth + 1):
        if k:
            level = [(2 * i + di, 2 * j + dj, near) for i, j, near in level for di in (0, 1) for dj in (0, 1)]
        w, h = (x1 - x0) / 2 ** k, (y1 - y0) / 2 ** k
        # Points are put into parts in floating point; a part is taken a little larger than it is.
        ex, ey = (abs(x0) + abs(x1)) * ROUNDING, (abs(y0) + abs(y1)) * ROUNDING
        level = [(i, j, near[_reachable((x0 + i * w - ex, x0 + (i + 1) * w + ex, y0 + j * h - ey, y0 + (j + 1) * h + ey),
                                        sx[near], sx[near], sy[near], sy[near])]) for i, j, near in level]
    return level


def nearest(points: DataFrame, stations: DataFrame, x: str = "x", y: str = "y", sid: str = "id", order: str = "ord") -> DataFrame:
    """Nearest station of each point (``station``, ``d2``) by squared planar distance; ties go to the first in ``order``.

    Exact.  A point whose coordinates are null or not finite, or any point where there is no station with finite ones,
    has a null station.  Points keep their columns and their rows, whatever these repeat; their
    columns must not be named ``station``, ``d2`` or ``_near_...``.
    """
    st = stations.select(F.col(sid).alias("_sid"), F.col(order).alias("_ord"), F.col("x").cast("double").alias("_sx"),
                         F.col("y").cast("double").alias("_sy")).filter(_placed(F.col("_sx"), F.col("_sy")))
    # stations on one spot cannot be told apart by distance: the first stands for them
    st = st.groupBy("_sx", "_sy").agg(F.min(F.struct("_ord", "_sid")).alias("f")).select("_sx", "_sy", "f.*")
    st = cut_lineage(st)
    n = st.count()
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    xs, ys = _cuts(st, n)
    st = st.withColumn("_b", _block(xs, ys, F.col("_sx"), F.col("_sy")))
    block = F.when(_placed(px, py), _block(xs, ys, px, py))
    at = _boxes(points.select(block.alias("_b"), px.alias("_x"), py.alias("_y")).filter("_b is not null"), "_x", "_y")
    if not n or not len(at):
        return points.select("*", F.lit(None).cast(stations.schema[sid].dataType).alias("station"), F.lit(None).cast("double").alias("d2"))
    own = _boxes(st, "_sx", "_sy")
    boxes, pairs = [], []
    for b, _, x0, x1, y0, y1 in at.itertuples(index=False):
        near = _reachable((x0, x1, y0, y1), *(own[c].to_numpy() for c in ("x0", "x1", "y0", "y1")))
        depth = min(DEEPEST, max(0, math.ceil(math.log(own["n"].to_numpy()[near].sum() / LISTED, 4))))
        # A box without extent is one column or row of parts.
        boxes.append((b, 2 ** depth, x0, y0, 2 ** depth / ((x1 - x0) or 1.0), 2 ** depth / ((y1 - y0) or 1.0)))
        pairs += [(int(k), b, depth, x0, x1 if x1 > x0 else x0 + 1.0, y0, y1 if y1 > y0 else y0 + 1.0) for k in own["b"].to_numpy()[near]]
    spark = points.sparkSession
    met = st.join(spark.createDataFrame(pairs, "_b int, b int, depth int, x0 double, x1 double, y0 double, y1 double"), "_b")
    types = {c: st.schema[c].dataType.simpleString() for c in ("_ord", "_sid")}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        rows = list(zip(pdf["_sx"].tolist(), pdf["_sy"].tolist(), pdf["_ord"].tolist(), pdf["_sid"].tolist(), strict=True))
        parts = _parts((one.x0, one.x1, one.y0, one.y1), int(one.depth), pdf["_sx"].to_numpy(), pdf["_sy"].to_numpy())
        return pd.DataFrame([(one.b, i, j, [rows[k] for k in near]) for i, j, near in parts], columns=["_near_b", "_near_i", "_near_j", "_near_list"])

    lists = hold(met.groupBy("b").applyInPandas(
        build, f"_near_b int, _near_i int, _near_j int, _near_list array<struct<x:double,y:double,ord:{types['_ord']},sid:{types['_sid']}>>"), "nearest-lists")
    # A row a block, so no more than BLOCKS.
    frame = F.broadcast(spark.createDataFrame(boxes, "_near_b int, _near_side int, _near_x0 double, _near_y0 double, _near_fx double, _near_fy double"))
    part = lambda v, low, f: F.least(F.floor((v - F.col(low)) * F.col(f)), F.col("_near_side") - 1).cast("int")
    placed = points.select("*", block.alias("_near_b")).join(frame, "_near_b", "left").withColumns(
        {"_near_i": part(px, "_near_x0", "_near_fx"), "_near_j": part(py, "_near_y0", "_near_fy")})

    def reach(s: Column) -> Column:
        dx, dy = px - s["x"], py - s["y"]
        return F.struct((dx * dx + dy * dy).alias("d2"), s["ord"].alias("ord"), s["sid"].alias("sid"))

    best = placed.join(lists, ["_near_b", "_near_i", "_near_j"], "left").withColumn("_near_best", F.array_min(F.transform("_near_list", reach)))
    return best.select(*points.columns, F.col("_near_best.sid").alias("station"), F.col("_near_best.d2").alias("d2"))
