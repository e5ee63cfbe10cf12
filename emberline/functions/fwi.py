"""Fire Weather Index system on arrays (Van Wagner 1987; Van Wagner and Pickett 1985).

Each function takes one day of many stations.  Unknown inputs give unknown outputs.  With ``m=SCALAR`` the same equations
take one station's numbers, which for single days is many times as fast as arrays of one.
"""

from __future__ import annotations

import math
from types import SimpleNamespace
from typing import Any

import numpy as np

#: The few array functions that the equations need, for plain numbers.
SCALAR = SimpleNamespace(
    exp=math.exp, log=math.log, sqrt=math.sqrt, maximum=max, minimum=min,
    where=lambda test, a, b: a if test else b, clip=lambda x, low, high: min(max(x, low), high))

# Effective day length for DMC by month, northern mid-latitudes first.
DMC_DAY = {
    "north": (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0),
    "north_low": (7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8),
    "equator": (9.0,) * 12,
    "south_low": (10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2),
    "south": (11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10.0, 11.2, 11.8),
}
# Day length factor for DC by month.
DC_NORTH = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
DC_DAY = {"north": DC_NORTH, "equator": (1.4,) * 12, "south": DC_NORTH[6:] + DC_NORTH[:6]}

_DMC = np.array(list(DMC_DAY.values()))
_DC = np.array(list(DC_DAY.values()))


def day_factors(lat: np.ndarray, month: np.ndarray, lat_adjust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """DMC and DC day-length factors by latitude band and month."""
    m = month.astype("int64") - 1
    if not lat_adjust:
        return _DMC[0][m], _DC[0][m]
    dmc_band = np.select([lat >= 30, lat >= 10, lat >= -10, lat >= -30], [0, 1, 2, 3], 4)
    dc_band = np.select([lat > 20, lat >= -20], [0, 1], 2)
    return _DMC[dmc_band, m], _DC[dc_band, m]


def ffmc_step(f0, t, h, w, p, m: Any = np):
    """Fine fuel moisture code of the day from yesterday's."""
    mo = 147.2 * (101 - f0) / (59.5 + f0)
    rf = m.maximum(p - 0.5, 1e-12)
    wet = mo + 42.5 * rf * m.exp(-100 / (251 - mo)) * (1 - m.exp(-6.93 / rf))
    wet = wet + m.where(mo > 150, 0.0015 * m.maximum(mo - 150, 0) ** 2 * m.sqrt(rf), 0.0)
    mo = m.where(p > 0.5, m.minimum(wet, 250), mo)
    side = 0.18 * (21.1 - t) * (1 - m.exp(-0.115 * h))
    ed = 0.942 * h ** 0.679 + 11 * m.exp((h - 100) / 10) + side
    ew = 0.618 * h ** 0.753 + 10 * m.exp((h - 100) / 10) + side
    warm = 0.581 * m.exp(0.0365 * t)

    def rate(x):
        return (0.424 * (1 - x ** 1.7) + 0.0694 * m.sqrt(w) * (1 - x ** 8)) * warm

    dry = ed + (mo - ed) * 10 ** -rate(h / 100)
    damp = ew - (ew - mo) * 10 ** -rate((100 - h) / 100)
    left = m.where(mo > ed, dry, m.where(mo < ew, damp, mo))
    return m.clip(59.5 * (250 - left) / (147.2 + left), 0, 101)


def dmc_step(p0, t, h, p, day, m: Any = np):
    """Duff moisture code."""
    rk = 1.894 * (m.maximum(t, -1.1) + 1.1) * (100 - h) * day * 1e-4
    rw = 0.92 * p - 1.27
    mo = 20 + m.exp(5.6348 - p0 / 43.43)
    safe = m.maximum(p0, 1e-9)
    b = m.where(p0 <= 33, 100 / (0.5 + 0.3 * p0),
                 m.where(p0 <= 65, 14 - 1.3 * m.log(safe), 6.2 * m.log(safe) - 17.2))
    mr = mo + 1000 * rw / (48.77 + b * rw)
    rained = m.maximum(0, 43.43 * (5.6348 - m.log(m.maximum(mr - 20, 1e-9))))
    return m.maximum(0, m.where(p > 1.5, rained, p0) + rk)


def dc_step(d0, t, p, day, m: Any = np):
    """Drought code."""
    pe = m.maximum(0, (0.36 * (m.maximum(t, -2.8) + 2.8) + day) / 2)
    rw = m.maximum(0.83 * p - 1.27, 0)
    rained = m.maximum(0, d0 - 400 * m.log(1 + 3.937 * rw / (800 * m.exp(-d0 / 400))))
    return m.maximum(0, m.where(p > 2.8, rained, d0) + pe)


def isi(ffmc, w, m: Any = np):
    """Initial spread index."""
    fm = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    return 0.208 * m.exp(0.05039 * w) * 91.9 * m.exp(-0.1386 * fm) * (1 + fm ** 5.31 / 4.93e7)


def bui(dmc, dc, m: Any = np):
    """Build-up index."""
    both = dmc + 0.4 * dc
    u = m.where(both == 0, 0.0, 0.8 * dc * dmc / m.where(both == 0, 1.0, both))
    gap = m.where(dmc == 0, 0.0, (dmc - u) / m.where(dmc == 0, 1.0, dmc))
    low = m.maximum(0, dmc - (0.92 + (0.0114 * dmc) ** 1.7) * gap)
    return m.where(u < dmc, low, u)


def fwi(isi_value, bui_value, m: Any = np):
    """Fire weather index."""
    fd = m.where(bui_value <= 80, 0.626 * bui_value ** 0.809 + 2, 1000 / (25 + 108.64 * m.exp(-0.023 * bui_value)))
    b = 0.1 * isi_value * fd
    return m.where(b > 1, m.exp(2.72 * (0.434 * m.log(m.maximum(b, 1.0))) ** 0.647), b)


def day(f0, p0, d0, t, h, w, p, month, lat, lat_adjust=True):
    """All seven outputs of one day: FFMC, DMC, DC, ISI, BUI, FWI, DSR."""
    h = np.minimum(h, 99.9999)
    le, lf = day_factors(lat, month, lat_adjust)
    f, d, c = ffmc_step(f0, t, h, w, p), dmc_step(p0, t, h, p, le), dc_step(d0, t, p, lf)
    i, u = isi(f, w), bui(d, c)
    v = fwi(i, u)
    return f, d, c, i, u, v, 0.0272 * v ** 1.77


def day_of_one(f0, p0, d0, t, h, w, p, month, lat, lat_adjust=True):
    """As :func:`day` for one station's plain numbers; None where an input is unknown or has no outputs."""
    if not all(map(math.isfinite, (t, h, w, p, lat))) or h < 0 or w < 0:
        return None
    h = min(h, 99.9999)
    dmc_day, dc_day = FACTORS_OF_ONE[band_of_one(lat) if lat_adjust else (0, 0)][month - 1]
    try:
        f, d, c = ffmc_step(f0, t, h, w, p, SCALAR), dmc_step(p0, t, h, p, dmc_day, SCALAR), dc_step(d0, t, p, dc_day, SCALAR)
        i, u = isi(f, w, SCALAR), bui(d, c, SCALAR)
        v = fwi(i, u, SCALAR)
        out = (f, d, c, i, u, v, 0.0272 * v ** 1.77)
    except (ValueError, OverflowError, ZeroDivisionError):
        return None
    return out if not any(isinstance(x, complex) or not math.isfinite(x) for x in out) else None


#: Days from which on arrays over one station's days are faster than its numbers day by day.
FEW_DAYS = 8
#: Drought codes beyond this are left to the equations day by day: the drying term vanishes from double precision.
FAR_DC = 2e5


def days_of_one(codes, t, h, w, p, month, lat, lat_adjust=True) -> tuple[np.ndarray, tuple[float, float, float]]:
    """As repeated :func:`day_of_one` over one station's days in order: seven outputs a day and the last three codes.

    An unknown day is a row of NaN and leaves the codes as they were.  What does not depend on yesterday is computed for all
    days at once, and so is what follows from the day's codes; only the step from code to code runs day by day.  Where an
    intermediate value is beyond double precision, the plain equations decide day by day.
    """
    if len(t) >= FEW_DAYS and 0 <= codes[0] <= 101 and 0 <= codes[1] < np.inf and 0 <= codes[2] <= FAR_DC:
        with np.errstate(all="ignore"):
            known = np.isfinite(t) & np.isfinite(h) & np.isfinite(w) & np.isfinite(p) & np.isfinite(lat) & (h >= 0) & (w >= 0)
            at = np.flatnonzero(known)
            out = np.full((len(t), 7), np.nan)
            try:
                got = _known_days(codes, *[x[at] for x in (t, h, w, p, month, lat)], lat_adjust)
            except (ValueError, OverflowError, ZeroDivisionError):
                got = None
        if got is not None and np.isfinite(got).all() and (not len(got) or got[:, 2].max() <= FAR_DC):
            out[at] = got
            return out, tuple(got[-1, :3].tolist()) if len(got) else tuple(codes)
    out, codes = [], tuple(codes)
    for x in zip(*[v.tolist() for v in (t, h, w, p, month, lat)], strict=True):
        got = day_of_one(*codes, *x, lat_adjust)
        codes = codes if got is None else got[:3]
        out.append((np.nan,) * 7 if got is None else got)
    return np.array(out, dtype="float64").reshape(-1, 7), codes


def _known_days(codes, t, h, w, p, month, lat, lat_adjust) -> np.ndarray | None:
    """Seven outputs of a station's days without unknown inputs; None where a term of the weather alone is not finite."""
    h = np.minimum(h, 99.9999)
    le, lf = day_factors(lat, month, lat_adjust)
    rf, root_rf, dry_rf = (x := np.maximum(p - 0.5, 1e-12)), np.sqrt(x), 1 - np.exp(-6.93 / x)
    side = 0.18 * (21.1 - t) * (1 - np.exp(-0.115 * h))
    ed = 0.942 * h ** 0.679 + 11 * np.exp((h - 100) / 10) + side
    ew = 0.618 * h ** 0.753 + 10 * np.exp((h - 100) / 10) + side
    warm, gust = 0.581 * np.exp(0.0365 * t), np.exp(0.05039 * w)
    kept = [10 ** -((0.424 * (1 - x ** 1.7) + 0.0694 * np.sqrt(w) * (1 - x ** 8)) * warm) for x in (h / 100, (100 - h) / 100)]
    rk = 1.894 * (np.maximum(t, -1.1) + 1.1) * (100 - h) * le * 1e-4
    pe = np.maximum(0, (0.36 * (np.maximum(t, -2.8) + 2.8) + lf) / 2)
    terms = [p, rf, root_rf, dry_rf, ed, ew, *kept, rk, pe]
    if not all(np.isfinite(x).all() for x in (*terms, warm, gust)):
        return None
    exp, log, (f, d, c), out = math.exp, math.log, codes, []
    for rain, rf, root, drying, ed, ew, dry, damp, rk, pe in zip(*[x.tolist() for x in terms], strict=True):
        mo = 147.2 * (101 - f) / (59.5 + f)
        if rain > 0.5:
            wet = mo + 42.5 * rf * exp(-100 / (251 - mo)) * drying
            mo = min(wet + 0.0015 * (mo - 150) ** 2 * root if mo > 150 else wet, 250)
        left = ed + (mo - ed) * dry if mo > ed else ew - (ew - mo) * damp if mo < ew else mo
        f = min(max(59.5 * (250 - left) / (147.2 + left), 0.0), 101.0)
        if rain > 1.5:
            b = 100 / (0.5 + 0.3 * d) if d <= 33 else 14 - 1.3 * log(d) if d <= 65 else 6.2 * log(d) - 17.2
            rw = 0.92 * rain - 1.27
            mr = 20 + exp(5.6348 - d / 43.43) + 1000 * rw / (48.77 + b * rw)
            d = max(0.0, 43.43 * (5.6348 - log(max(mr - 20, 1e-9))))
        d = max(0.0, d + rk)
        if rain > 2.8:
            c = max(0.0, c - 400 * log(1 + 3.937 * (0.83 * rain - 1.27) / (800 * exp(-c / 400))))
        c = max(0.0, c + pe)
        out.append((f, d, c))
    f, d, c = np.array(out, dtype="float64").reshape(-1, 3).T
    i, u = isi(f, w), bui(d, c)
    v = fwi(i, u)
    return np.stack([f, d, c, i, u, v, 0.0272 * v ** 1.77], axis=1)


def band_of_one(lat: float) -> tuple[int, int]:
    """Rows of the DMC and DC day-length factors of a latitude."""
    return next(k for k, low in enumerate((30, 10, -10, -30, -math.inf)) if lat >= low), 0 if lat > 20 else 1 if lat >= -20 else 2


#: Both factors of each month for each pair of bands.
FACTORS_OF_ONE = {(a, b): list(zip(dmc, dc)) for a, dmc in enumerate(DMC_DAY.values()) for b, dc in enumerate(DC_DAY.values())}
