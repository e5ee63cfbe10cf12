"""How well classes account for measured metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import UnknownName, notice
from emberline.functions.constants import PROFILE_METRICS
from emberline.grid import GridSpec
from emberline.operators.rank import auc, quantiles


def default_metrics(available: list[str]) -> list[str]:
    hit = [m for m in PROFILE_METRICS if m in available]
    return hit or list(available)


def upsampling_notes(fuel: GridSpec, reference: GridSpec) -> list[str]:
    """What regridding did to the sample behind a profile."""
    notes = []
    if fuel != reference:
        notes.append(f"reference resampled from {reference.res} to {fuel.res} (bilinear)")
    if reference.res > fuel.res * 1.001:
        share = (reference.res / fuel.res) ** 2
        notes.append(f"upsampling: one measurement covers about {share:.1f} cells, so the statistics are optimistic")
        notice(notes[-1])
    return notes


def long_metrics(cells: DataFrame, metrics: list[str], by: str = "class") -> DataFrame:
    """(class, metric, value) for classed cells with a measurement."""
    missing = [m for m in metrics if m not in cells.columns]
    if missing:
        raise UnknownName(f"no metric {missing}")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return cells.filter(F.col(by).isNotNull()).select(F.col(by).alias("class"), F.inline(pairs))


def summarise(cells: DataFrame, metrics: list[str], by: str = "class") -> DataFrame:
    """Count and quartiles of every metric in every class; classes without a value keep a row."""
    rows = long_metrics(cells, metrics, by)
    counts = rows.groupBy("class", "metric").agg(F.count("value").alias("n"))
    q = quantiles(rows, "value", [0.25, 0.5, 0.75], ["class", "metric"])
    wide = q.groupBy("class", "metric").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return counts.join(wide, ["class", "metric"], "left")


def explained(cells: DataFrame, metrics: list[str], by: str = "class") -> DataFrame:
    """Share of each metric's variance that lies between classes."""
    rows = long_metrics(cells, metrics, by).filter(F.col("value").isNotNull())
    per = rows.groupBy("metric", "class").agg(
        F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = per.groupBy("metric").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_classes"), F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    between = per.join(total.select("metric", "gm"), "metric").groupBy("metric").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("between"))
    both = F.col("within") + F.col("between")
    share = F.when((F.col("n") > 1) & (F.col("n_classes") > 1) & (both > 0), 1 - F.col("within") / both)
    return total.join(between, "metric").select(
        "metric", F.col("n").cast("long").alias("n"), "n_classes", share.alias("explained"))


def separability(cells: DataFrame, metrics: list[str], target: str, min_cells: int = 30, by: str = "class") -> DataFrame:
    """AUC of each metric for one class against the rest; withheld for small samples."""
    sizes = cells.filter(F.col(by).isNotNull()).agg(
        F.count_if(F.col(by) == target).alias("n_class"), F.count_if(F.col(by) != target).alias("n_other"))
    if cells.filter(F.col(by) == target).isEmpty():
        raise UnknownName(f"class '{target}' is not in the layer")
    rows = long_metrics(cells, metrics, by).withColumn("hit", F.col("class") == target)
    got = auc(rows, "value", "hit", ["metric"])
    n = sizes.select(F.struct("n_class", "n_other").alias("s")).scalar()
    enough = (F.col("n_pos") >= min_cells) & (F.col("n_neg") >= min_cells)
    return got.select("metric", n["n_class"].alias("n_class"), n["n_other"].alias("n_other"),
                      F.when(enough, F.col("auc")).alias("separability"))
