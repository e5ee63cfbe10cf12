"""Satellite scenes: selection around a fire, NBR and dNBR, choice of the pre-fire pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.grid import CELL
from emberline.operators.rank import quantiles
from emberline.operators.raster import mosaic


def scene_windows(span: DataFrame, pre_days: int = 45, post_days: int = 45, buffer_days: int = 3) -> DataFrame:
    """Date windows before and after a fire span, kept clear of it by a buffer."""
    return span.select(
        "*", F.date_sub("fire_start", buffer_days + pre_days).alias("pre_from"), F.date_sub("fire_start", buffer_days).alias("pre_to"),
        F.date_add("fire_end", buffer_days).alias("post_from"), F.date_add("fire_end", buffer_days + post_days).alias("post_to"))


def scene_candidates(catalog: DataFrame, max_cloud: float = 20.0, within: Column | None = None, order: str = "scene") -> DataFrame:
    """Passes clear enough to use, clearest first.

    One scene per date and tile (the first in ``order``), then mean cloud per date.
    """
    items = catalog if within is None else catalog.filter(within)
    one = items.groupBy("date", "tile").agg(F.min_by("cloud", order).alias("cloud"), F.min(order).alias(order))
    passes = one.groupBy("date").agg(F.avg("cloud").alias("cloud"), F.count("*").alias("n_tiles"))
    return passes.filter(F.col("cloud") <= max_cloud).orderBy("cloud", "date")


def first_candidates(candidates: DataFrame, n: int) -> DataFrame:
    return candidates.orderBy("cloud", "date").limit(n)


def nbr(bands: DataFrame, scene: str = "scene", tile: str = "tile", nir: str = "nir", swir: str = "swir") -> DataFrame:
    """Normalised burn ratio per scene and cell, tiles laid over each other first-wins."""
    total = F.col(nir) + F.col(swir)
    ratio = F.when(total != 0, (F.col(nir) - F.col(swir)) / total)
    return mosaic(bands.select(scene, tile, *CELL, ratio.alias("nbr")), "nbr", tile, [scene])


def dnbr(pre: DataFrame, post: DataFrame, scene: str = "scene") -> DataFrame:
    """Change of NBR of each pre-fire scene against the post-fire scene."""
    after = post.select(*CELL, F.col("nbr").alias("_post"))
    return pre.join(after, CELL).select(scene, *CELL, (F.col("nbr") - F.col("_post")).alias("dnbr"))


def rank_pre_scenes(change: DataFrame, perimeter: DataFrame, ncell: int, scene: str = "scene", min_coverage: float = 0.95,
                    n_candidates: int | None = None, order: DataFrame | None = None) -> DataFrame:
    """Pre-fire scenes by how quiet they are outside the fire.

    Coverage is measured against the requested grid, not the cells a scene happens
    to have.  Among those that cover enough - the first ``n_candidates`` in the
    catalog ``order`` - the smallest absolute median outside the perimeter wins.
    """
    cov = change.groupBy(scene).agg((F.count("dnbr") / F.lit(float(ncell))).alias("coverage")).filter(
        F.col("coverage") >= min_coverage)
    if n_candidates is not None and order is not None:
        cov = cov.join(order, scene).orderBy("ord").limit(n_candidates).drop("ord")
    outside = change.join(perimeter.select(*CELL).distinct(), CELL, "left_anti").filter(F.col("dnbr").isNotNull())
    control = quantiles(outside.join(cov.select(scene), scene, "left_semi"), "dnbr", [0.5], [scene]).select(
        scene, F.col("q").alias("control"))
    ranked = cov.join(control, scene, "left")
    w = Window.partitionBy(F.lit(0)).orderBy(F.abs("control").asc_nulls_last(), scene)
    return ranked.withColumn("rank", F.row_number().over(w))
