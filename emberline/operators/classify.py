"""Interval classification; every scheme states which side of a break is closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.errors import EmberError, RoleRefused
from emberline.functions.constants import DANGER_SCHEMES
from emberline.functions.scalars import col


def _chain(pairs: list[tuple[Column, object]], last) -> Column:
    out = None
    for cond, v in pairs:
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return F.lit(last) if out is None else out.otherwise(last)


def scheme(name: str = "effis", breaks=None, labels=None) -> tuple[list[float], list[str]]:
    """Breaks and labels of a danger scheme, checked."""
    preset = DANGER_SCHEMES[name]
    breaks, labels = list(breaks or preset[0]), list(labels or preset[1])
    if len(labels) != len(breaks) + 1:
        raise EmberError("labels must have one more element than breaks")
    if any(b <= a for a, b in zip(breaks, breaks[1:])):
        raise EmberError("breaks must be strictly increasing")
    return breaks, labels


def danger_class(cells: DataFrame, value: str, name: str = "effis", breaks=None, labels=None, role: str = "",
                 out: str = "danger_class") -> DataFrame:
    """Class label and ordinal; a value equal to a break belongs to the upper class."""
    if role == "fwi_percentile":
        raise RoleRefused("class breaks are in index units; a percentile layer must not be cut by them")
    breaks, labels = scheme(name, breaks, labels)
    v = F.col(value)
    known = v.isNotNull() & ~F.isnan(v.cast("double"))
    ordinal = _chain([(v < b, i + 1) for i, b in enumerate(breaks)], len(labels))
    label = _chain([(v < b, lab) for b, lab in zip(breaks, labels)], labels[-1])
    return cells.withColumns({out: F.when(known, label), f"{out}_ord": F.when(known, ordinal)})


def right_closed_band(value, breaks: list[float]) -> Column:
    """Band 1..n of (lo, hi] with the lowest break included; null outside."""
    v = col(value)
    inner = _chain([(v <= b, i + 1) for i, b in enumerate(breaks[1:])], None)
    return F.when((v >= breaks[0]) & (v <= breaks[-1]), inner)


def score_bin(value, breaks: list[float]) -> Column:
    """Ordinal of a score among class breaks.

    Bins are (lo, hi], except that a score equal to the first break falls in the
    second bin; scores past the last break stay in the last bin.
    """
    v, breaks = col(value), sorted(breaks)
    pairs = [(v < breaks[0], 1)] if len(breaks) > 1 else []
    pairs += [(v <= b, i + 2) for i, b in enumerate(breaks[1:])]
    return F.when(v.isNotNull(), _chain([(c, F.lit(k)) for c, k in pairs], F.lit(len(breaks))))
