"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null although greatest and least skip it."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def least_strict(*cs) -> Column:
    """Smallest value, null when any is null."""
    cs = [col(c) for c in cs]
    known = cs[0].isNotNull()
    for c in cs[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.least(*cs))


def unit_or_error(c, name: str) -> Column:
    """The value itself, or a failed task when it leaves [0, 1].

    The check rides along with the scan instead of costing a pass of its own.
    """
    c = col(c)
    bad = F.raise_error(F.concat(F.lit(f"{name} must lie in [0, 1], got "), c.cast("string"))).cast("double")
    return F.when(c.isNull() | c.between(0, 1), c).otherwise(bad)


def signif(c, digits: int) -> Column:
    """Round to significant digits, half to even."""
    c = col(c)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.bround(c / scale) * scale)


def rh_at_temperature(t_old, rh_old, t_new) -> Column:
    """Relative humidity after a change of temperature at constant dew point (Magnus)."""
    a, b = 17.67, 243.5
    t_old, t_new = col(t_old), col(t_new)
    gamma = F.log(clamp(rh_old, 1e-3, 100) / 100) + a * t_old / (b + t_old)
    dew = b * gamma / (a - gamma)
    return clamp(100 * F.exp(a * dew / (b + dew) - a * t_new / (b + t_new)), 1, 100)


def byram_intensity(load, spread, heat_yield: float = 18000.0) -> Column:
    """Fireline intensity in kW/m from load (kg/m2) and spread rate (m/min)."""
    return F.lit(float(heat_yield)) * col(load) * col(spread) / 60


def crown_ignition_intensity(cbh, fmc) -> Column:
    """Surface intensity (kW/m) above which a crown of this base height ignites."""
    return F.pow(col(cbh) * (F.lit(460.0) + 25.9 * col(fmc)) / 100, F.lit(1.5))


def crown_spread_rate(cbd) -> Column:
    """Spread rate (m/min) above which a crown of this bulk density carries fire."""
    return F.lit(3.0) / col(cbd)


def flex_date(c) -> Column:
    """Date from text whose first ten characters are in either of two formats."""
    head = F.substring(col(c), 1, 10)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyy/MM/dd"))


def truthy(c) -> Column:
    """Three-valued flag from text; null where the text is neither yes nor no."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("true", "t", "1", "yes", "y"), F.lit(True)).when(
        t.isin("false", "f", "0", "no", "n"), F.lit(False))


def tile_key(lon, lat, step: int) -> Column:
    """Name of the lon/lat tile a point falls in, from its south-west corner."""
    x, y = F.floor(col(lon) / step) * step, F.floor(col(lat) / step) * step
    ns, ew = F.when(y < 0, "S").otherwise("N"), F.when(x < 0, "W").otherwise("E")
    return F.concat(ns, F.lpad(F.abs(y).cast("string"), 2, "0"), ew, F.lpad(F.abs(x).cast("string"), 3, "0"))


def metric_tile_key(x, y, x0: float, y_top: float, side: float, first_col: int = 1) -> Column:
    """Row/column name of a projected tile, rows counted from the top."""
    r = F.floor((F.lit(float(y_top)) - col(y)) / side)
    c = F.floor((col(x) - F.lit(float(x0))) / side) + first_col
    return F.concat(F.lit("R"), r.cast("string"), F.lit("_C"), c.cast("string"))
