"""Window shapes as offset lists on the driver; their size depends on radius / res only."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from emberline.errors import ResolutionTooCoarse, WindowTooLarge
from emberline.grid import GridSpec

Offsets = list[tuple[int, int]]
Runs = list[tuple[int, int, int]]


def window_side(res: float, reach: float) -> int:
    """Cells along one side, always odd."""
    n = math.floor(2 * reach / res + 1)
    return n + 1 if n % 2 == 0 else n


def _square(res: float, reach: float):
    half = window_side(res, reach) // 2
    dy, dx = np.mgrid[-half:half + 1, -half:half + 1]
    return dy, dx, np.sqrt((dx * res) ** 2.0 + (dy * res) ** 2.0)


def _pick(dy, dx, mask) -> Offsets:
    return [(int(a), int(b)) for a, b in zip(dy[mask], dx[mask])]


def annulus(res: float, radius: float) -> Offsets:
    """Offsets at a distance in [res, radius]; the centre is never in."""
    dy, dx, d = _square(res, radius)
    return _pick(dy, dx, (d >= res) & (d <= radius))


def disc(res: float, distance: float) -> Offsets:
    """Offsets within a distance, centre included."""
    dy, dx, d = _square(res, distance)
    return _pick(dy, dx, d <= distance)


def sectors(res: float, radius: float, n_sectors: int) -> tuple[list[Offsets], list[float]]:
    """The annulus split by compass bearing, the first sector centred on north."""
    dy, dx, d = _square(res, radius)
    ring = (d >= res) & (d <= radius)
    width = 360.0 / n_sectors
    bearing = np.degrees(np.arctan2(dx * res, -dy * res)) % 360
    which = np.floor(((bearing + width / 2) % 360) / width).astype(int) % n_sectors
    parts = [_pick(dy, dx, ring & (which == k)) for k in range(n_sectors)]
    return parts, [k * width for k in range(n_sectors)]


def to_runs(offsets: Offsets) -> Runs:
    """Offsets as horizontal runs (dy, first dx, last dx), so a row sum needs two look-ups."""
    by_row = defaultdict(list)
    for dy, dx in offsets:
        by_row[dy].append(dx)
    runs = []
    for dy in sorted(by_row):
        xs = sorted(by_row[dy])
        start = prev = xs[0]
        for x in xs[1:]:
            if x != prev + 1:
                runs.append((dy, start, prev))
                start = x
            prev = x
        runs.append((dy, start, prev))
    return runs


def reach_of(offsets: Offsets) -> int:
    return max((max(abs(a), abs(b)) for a, b in offsets), default=0)


def check_radius(grid: GridSpec, radius: float) -> None:
    """Refuse a radius the grid cannot resolve or hold."""
    if radius <= 0:
        raise WindowTooLarge("radius must be positive")
    if grid.res > radius / 3:
        raise ResolutionTooCoarse(f"cells of {grid.res} are too coarse for a radius of {radius}; needs res <= radius/3")
    side = window_side(grid.res, radius)
    if side * 2 >= grid.nrow or side * 2 >= grid.ncol:
        raise WindowTooLarge(f"window of {side} cells against a {grid.nrow} x {grid.ncol} layer")


def default_radii(grid: GridSpec, n: int = 7) -> list[float]:
    """Log-spaced sweep from three cells to a tenth of the shorter side, two significant digits."""
    lo = 3 * grid.res
    hi = max(min(grid.nrow, grid.ncol) * grid.res / 10, 2 * lo)
    steps = np.exp(np.linspace(math.log(lo), math.log(hi), n))
    return [float(f"{s:.1e}") for s in steps]
