import numpy as np
import pytest

from emberline.errors import BadRange, EmberError, ResolutionTooCoarse, WindowTooLarge
from emberline.operators import focal, terrain, windows


def brute(a, offsets, need_all=True):
    n = len(offsets)
    out = np.full(a.shape, np.nan)
    for r, c in np.ndindex(a.shape):
        vals = [a[r + dy, c + dx] for dy, dx in offsets if 0 <= r + dy < a.shape[0] and 0 <= c + dx < a.shape[1]]
        vals = [v for v in vals if not np.isnan(v)]
        if not need_all or len(vals) == n:
            out[r, c] = sum(vals) / n
    return out


@pytest.fixture(scope="module")
def holed():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 5, (33, 41)) / 4.0
    a[rng.random(a.shape) < 0.03] = np.nan
    return a


def test_ring_sizes():
    assert len(windows.annulus(25, 100)) == 48
    assert len(windows.annulus(25, 500)) == 1256
    assert len(windows.annulus(10, 30)) == 28
    assert (0, 0) not in windows.annulus(25, 100) and (0, 0) in windows.disc(25, 100)


def test_sectors_partition_the_annulus():
    parts, bearings = windows.sectors(25, 300, 8)
    assert sorted(o for p in parts for o in p) == sorted(windows.annulus(25, 300))
    assert (-3, 0) in parts[0] and (0, 3) in parts[2] and bearings[2] == 90


def test_runs_cover_offsets_once():
    ring = windows.annulus(25, 250)
    runs = windows.to_runs(ring)
    assert sorted((dy, x) for dy, a, b in runs for x in range(a, b + 1)) == sorted(ring)
    assert len(runs) == 22


@pytest.mark.parametrize("strategy", ["tiles", "offsets", "prefix"])
@pytest.mark.parametrize("na_rm", [False, True])
def test_strategies_match_brute_force(holed, grid_of, to_array, strategy, na_rm):
    df, grid = grid_of(holed)
    got = to_array(focal.exposure(df, grid, "value", 100, strategy=strategy, na_rm=na_rm), grid, "exposure")
    np.testing.assert_allclose(got, brute(holed, windows.annulus(25, 100), not na_rm), atol=1e-9)


def test_small_tiles_agree_across_borders(holed, grid_of, to_array):
    df, grid = grid_of(holed)
    ring = windows.annulus(25, 100)
    got = focal.focal_sums(df, grid, ["value"], {"k": ring}, side=7)
    np.testing.assert_allclose(to_array(got, grid, "value_k_sum"), brute(holed, ring, False) * len(ring), atol=1e-9)


def test_block_is_one_inside_zero_outside_and_centre_is_excluded(grid_of, to_array):
    a = np.zeros((40, 40))
    a[10:30, 10:30] = 1
    df, grid = grid_of(a)
    e = to_array(focal.exposure(df, grid, "value", 100), grid, "exposure")
    assert e[20, 20] == 1 and e[5, 35] == 0 and np.isnan(e[0, 0])
    alone = np.zeros((40, 40))
    alone[20, 20] = 1
    df, grid = grid_of(alone)
    assert to_array(focal.exposure(df, grid, "value", 100), grid, "exposure")[20, 20] == 0


def test_guards(grid_of):
    df, grid = grid_of(np.zeros((20, 20)))
    with pytest.raises(ResolutionTooCoarse):
        focal.exposure(df, grid, "value", 60)
    with pytest.raises(WindowTooLarge):
        focal.exposure(df, grid, "value", 250)
    with pytest.raises(EmberError):
        focal.exposure(df, grid, "value", 100, strategy="guess")
    bad, grid = grid_of(np.full((20, 20), 2.0))
    with pytest.raises(Exception, match="must lie in"):
        focal.exposure(bad, grid, "value", 100).collect()


def test_zero_kappas_equal_isotropic(holed, grid_of, to_array):
    df, grid = grid_of(holed)
    iso = to_array(focal.exposure(df, grid, "value", 100), grid, "exposure")
    same = focal.exposure_directional_weighted(df, grid, "value", 100)
    np.testing.assert_allclose(to_array(same, grid, "exposure"), iso, atol=1e-9)


def test_wind_pulls_toward_fuel_upwind(grid_of, to_array):
    a = np.zeros((40, 40))
    a[:20] = 1
    df, grid = grid_of(a)
    north = focal.exposure_directional_weighted(df, grid, "value", 100, wind=0, kappa_wind=2)
    south = focal.exposure_directional_weighted(df, grid, "value", 100, wind=180, kappa_wind=2)
    assert to_array(north, grid, "exposure")[21, 20] > to_array(south, grid, "exposure")[21, 20]


def test_interface_sides_and_nulls(grid_of, to_array, spark):
    a = np.full((20, 20), np.nan)
    a[10, 10] = 1
    df, grid = grid_of(a, name="asset")
    cells = df.selectExpr("*", "case when row = 10 and col = 13 then 1.0 end as fuel")
    got = {s: to_array(focal.interface(cells, grid, "asset", "fuel", 100, side=s), grid, "wui") for s in ("assets", "fuel", "both")}
    assert got["assets"].sum() == 1 and got["assets"][10, 10] == 1
    assert got["fuel"].sum() == 1 and got["fuel"][10, 13] == 1
    assert got["both"].sum() == 2
    with pytest.raises(BadRange):
        focal.interface(cells, grid, "asset", "fuel", 10)


def test_no_burn_masks_result_only(grid_of, to_array):
    df, grid = grid_of(np.ones((20, 20)))
    mask = df.selectExpr("row", "col", "case when row = 10 and col = 10 then 1 end as no_burn")
    e = to_array(focal.exposure(df, grid, "value", 100, no_burn=mask), grid, "exposure")
    assert np.isnan(e[10, 10]) and e[10, 11] == 1
    wrong = df.selectExpr("row", "col", "2 as no_burn")
    with pytest.raises(Exception, match="1 or null"):
        focal.exposure(df, grid, "value", 100, no_burn=wrong).collect()


def test_plane_slope_aspect_and_flat_ground(grid_of, to_array):
    r, c = np.indices((8, 8))
    df, grid = grid_of(c * 25.0)
    t = terrain.slope_aspect(df, grid, "value")
    assert to_array(t, grid, "slope")[4, 4] == pytest.approx(45)
    assert to_array(t, grid, "aspect")[4, 4] == pytest.approx(270)
    df, grid = grid_of(r * 25.0)
    assert to_array(terrain.slope_aspect(df, grid, "value"), grid, "aspect")[4, 4] == pytest.approx(0)
    df, grid = grid_of(np.zeros((8, 8)))
    flat = terrain.slope_aspect(df, grid, "value")
    assert to_array(flat, grid, "slope")[4, 4] == 0 and np.isnan(to_array(flat, grid, "aspect")[4, 4])


def test_curvature_sign_and_scale(grid_of, to_array):
    a = np.zeros((9, 9))
    a[4, 4] = 10
    df, grid = grid_of(a)
    c = to_array(terrain.curvature(df, grid, "value", 25), grid, "curvature")
    assert c[4, 4] == pytest.approx(0.5) and c[4, 5] < 0 and np.isnan(c[0, 0])
    with pytest.raises(WindowTooLarge):
        terrain.curvature(df, grid, "value", 500)
