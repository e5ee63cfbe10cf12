"""Map algebra: rescaling, combination and crown-fire arithmetic on cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.errors import AllNull, BadRange, BadWeights, EmberError, RoleRefused
from emberline.functions.scalars import (
    byram_intensity, clamp, crown_ignition_intensity, crown_spread_rate, least_strict, unit_or_error,
)
from emberline.grid import CELL
from emberline.operators.rank import percentile_rank


def value_range(cells: DataFrame, value: str) -> tuple[float, float]:
    """Least and greatest value in one pass; refuses a layer without any."""
    lo, hi = cells.agg(F.min(value), F.max(value)).first()
    if lo is None:
        raise AllNull(f"'{value}' is entirely null")
    return lo, hi


def check_unit_range(cells: DataFrame, values: list[str]) -> None:
    """Refuse layers that are empty or leave [0, 1]; all layers share one pass."""
    row = cells.agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for v in values:
        lo, hi = row[f"lo_{v}"], row[f"hi_{v}"]
        if lo is None:
            raise AllNull(f"'{v}' is entirely null")
        if lo < 0 or hi > 1:
            raise BadRange(f"'{v}' must lie in [0, 1], got {lo} to {hi}")


def check_weights(weights: list[float], n: int) -> list[float]:
    if len(weights) != n or any(w is None or w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-8:
        raise BadWeights(f"{n} non-negative weights that sum to 1 are needed, got {weights}")
    return list(weights)


def _extent(cells: DataFrame, expr: Column, name: str) -> tuple[Column, Column]:
    """Global range as scalar subqueries; a constant layer fails when it is used."""
    rng = cells.agg(F.min(expr).alias("lo"), F.max(expr).alias("hi"))
    ok = F.when(F.col("lo") < F.col("hi"), F.struct("lo", "hi")).otherwise(
        F.when(F.col("lo").isNull(), F.raise_error(F.lit(f"'{name}' is entirely null")))
        .otherwise(F.raise_error(F.lit(f"'{name}' is constant"))).cast("struct<lo:double,hi:double>"))
    got = rng.select(ok.alias("r")).scalar()
    return got["lo"], got["hi"]


def minmax(cells: DataFrame, values: list[str]) -> DataFrame:
    """Rescale each layer on its own range over every row, series included."""
    out = {}
    for v in values:
        lo, hi = _extent(cells, F.col(v).cast("double"), v)
        out[v] = (F.col(v) - lo) / (hi - lo)
    return cells.withColumns(out)


def log_rescale(cells: DataFrame, value: str) -> DataFrame:
    """Rescale log(1 + v) on its range; negative values are refused."""
    v = F.col(value).cast("double")
    safe = F.when(v < 0, F.raise_error(F.lit(f"'{value}' must not be negative")).cast("double")).otherwise(F.log1p(v))
    lo, hi = _extent(cells, safe, value)
    return cells.withColumn(value, (safe - lo) / (hi - lo))


def vulnerability_layer(cells: DataFrame, value: str, method: str = "minmax", invert: bool = False,
                        limits: tuple[float, float] | None = None, out: str = "vulnerability") -> DataFrame:
    """One vulnerability dimension in [0, 1]: min-max, log or percentile rank, maybe inverted."""
    base = cells.withColumn(out, F.col(value).cast("double"))
    if limits is not None:
        if limits[0] >= limits[1]:
            raise BadRange("limits must be low < high")
        base = base.withColumn(out, clamp(out, *limits))
    if method == "minmax":
        res = minmax(base, [out])
    elif method == "log":
        res = log_rescale(base, out)
    elif method == "percentile_rank":
        res = percentile_rank(base, out, "centred", "_pr").withColumn(out, F.col("_pr")).drop("_pr")
    else:
        raise EmberError(f"unknown method '{method}'")
    return res.withColumn(out, 1 - F.col(out)) if invert else res


def load_weight(cells: DataFrame, metric: str, method: str = "minmax", limits: tuple[float, float] | None = None,
                fill: float | None = None, out: str = "availability") -> DataFrame:
    """Graded availability from a measured metric; a constant metric weighs 1.

    Unmeasured cells stay null unless a fill in [0, 1] is given on purpose.
    """
    if fill is not None and not 0 <= fill <= 1:
        raise BadRange("fill must lie in [0, 1]")
    base = cells.withColumn(out, F.col(metric).cast("double"))
    if limits is not None:
        base = base.withColumn(out, clamp(out, *limits))
    if method == "percentile_rank":
        res = percentile_rank(base, out, "spread", "_pr").withColumn(out, F.col("_pr")).drop("_pr")
    elif method in ("minmax", "log"):
        v = F.col(out)
        if method == "log":
            v = F.when(v < 0, F.raise_error(F.lit(f"'{metric}' must not be negative")).cast("double")).otherwise(F.log1p(v))
        r = base.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("r")).scalar()
        lo, hi = r["lo"], r["hi"]
        res = base.withColumn(out, F.when(v.isNotNull(), F.when(lo == hi, F.lit(1.0)).otherwise((v - lo) / (hi - lo))))
    else:
        raise EmberError(f"unknown method '{method}'")
    return res if fill is None else res.withColumn(out, F.coalesce(out, F.lit(float(fill))))


def weighted_stack(cells: DataFrame, values: list[str], weights: list[float] | None = None,
                   method: str = "weighted_mean", out: str = "vulnerability") -> DataFrame:
    """Combine dimensions: weighted mean (null spreads) or maximum (null is skipped)."""
    if len(values) < 2:
        raise EmberError("at least two layers are needed")
    safe = [unit_or_error(v, v) for v in values]
    if method == "max":
        return cells.withColumn(out, F.greatest(*safe))
    w = check_weights(weights if weights is not None else [1 / len(values)] * len(values), len(values))
    return cells.withColumn(out, sum((s * F.lit(float(x)) for s, x in zip(safe[1:], w[1:])), safe[0] * F.lit(float(w[0]))))


def normalise_danger(cells: DataFrame, value: str, how: str = "auto", role: str = "") -> DataFrame:
    """Danger in [0, 1]: percentile / 100, min-max over the whole series, or as it is."""
    if how == "auto":
        if role != "fwi_percentile":
            raise RoleRefused("only a percentile layer can be normalised without saying how")
        how = "percentile"
    if how == "percentile":
        return cells.withColumn(value, unit_or_error(F.col(value) / 100, value))
    if how == "minmax":
        return minmax(cells, [value])
    if how == "none":
        return cells.withColumn(value, unit_or_error(value, value))
    raise EmberError(f"unknown normalisation '{how}'")


def danger_index(danger: DataFrame, availability: DataFrame, d: str = "danger", a: str = "availability",
                 method: str = "product", weights: tuple[float, float] = (0.5, 0.5), out: str = "index") -> DataFrame:
    """Danger on available fuel, for one layer or a dated series.

    The availability layer has no date: it joins every day of the series on the cell.
    """
    x, y = F.col(d), F.col(a)
    if method == "product":
        res = x * y
    elif method == "min":
        res = least_strict(x, y)
    elif method == "mean":
        w = check_weights(list(weights), 2)
        res = x * w[0] + y * w[1]
    elif method == "geometric":
        res = F.sqrt(x * y)
    else:
        raise EmberError(f"unknown method '{method}'")
    return danger.join(availability.select(*CELL, a), CELL).withColumn(out, res)


def risk_mean(cells: DataFrame, dims: list[str], weights: list[float] | None = None, normalise: str = "minmax",
              out: str = "risk") -> DataFrame:
    """Composite risk as a mean of dimensions, each rescaled on its own range unless told not to."""
    if len(dims) < 2:
        raise EmberError("at least two dimensions are needed")
    w = check_weights(weights if weights is not None else [1 / len(dims)] * len(dims), len(dims))
    tmp = {f"_{v}": F.col(v).cast("double") for v in dims}
    base = cells.withColumns(tmp)
    names = list(tmp)
    if normalise == "minmax":
        base = minmax(base, names)
    else:
        base = base.withColumns({n: unit_or_error(n, n) for n in names})
    terms = [F.col(n) * F.lit(float(x)) for n, x in zip(names, w)]
    return base.withColumn(out, sum(terms[1:], terms[0])).drop(*names)


def fireline(cells: DataFrame, load: str, spread: str, heat_yield: float = 18000.0) -> DataFrame:
    return cells.withColumn("intensity", byram_intensity(load, spread, heat_yield))


def crown_fire(cells: DataFrame, cbh: str, cbd: str, fmc, intensity: str, spread: str) -> DataFrame:
    """Crown ignition threshold, crown spread threshold and whether each is passed."""
    fmc = F.col(fmc) if isinstance(fmc, str) else F.lit(float(fmc))
    return cells.withColumns({
        "i0": crown_ignition_intensity(cbh, fmc), "r0": crown_spread_rate(cbd),
    }).withColumns({
        "ignites": F.col(intensity) > F.col("i0"), "active": F.col(spread) >= F.col("r0"),
    })


def crowning_share(cells: DataFrame, by: str) -> DataFrame:
    """Share of cells per class or zone whose crowns ignite, and that carry active fire."""
    return cells.groupBy(by).agg(
        F.count("ignites").alias("cells"), F.avg(F.col("ignites").cast("double")).alias("share_ignites"),
        F.avg((F.col("ignites") & F.col("active")).cast("double")).alias("share_active"))


def layer_summary(layers: DataFrame, ncell: int, layer: str = "layer", value: str = "value") -> DataFrame:
    """Range and share of missing cells per layer of a long table; absent cells count as missing."""
    return layers.groupBy(layer).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_valid"),
        (100.0 * (F.lit(ncell) - F.count(value)) / F.lit(ncell)).alias("pct_null"))
