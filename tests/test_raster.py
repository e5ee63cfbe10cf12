import numpy as np
import pytest

from emberline.errors import EmberError
from emberline.grid import GridSpec
from emberline.operators import raster

RINGS = "array<array<struct<x:double,y:double>>>"


def polygons(spark, *shapes):
    rows = [(i + 1, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s]) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, f"fid long, rings {RINGS}")


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


STAR = [[(103, 11), (163, 205), (7, 81), (199, 83), (37, 207)]]
DONUT = [[(11, 11), (189, 11), (189, 189), (11, 189)], [(61, 61), (61, 141), (141, 141), (141, 61)]]


@pytest.mark.parametrize("shape", [STAR, DONUT])
def test_rasterize_matches_point_tests(spark, shape):
    grid = GridSpec(0, 220, 10, 22, 22)
    got = {(r["row"], r["col"]) for r in raster.rasterize(polygons(spark, shape), grid, "fid").collect()}
    want = {(r, c) for r in range(22) for c in range(22) if inside((c + .5) * 10, 220 - (r + .5) * 10, shape)}
    assert got == want


def test_touching_cells_follow_a_thin_outline(spark):
    grid = GridSpec(0, 100, 10, 10, 10)
    sliver = [[(12, 12), (88, 88), (88.1, 87.9)]]
    assert raster.rasterize(polygons(spark, sliver), grid, "fid").count() <= 8
    got = {(r["row"], r["col"]) for r in raster.rasterize(polygons(spark, sliver), grid, "fid", touches=True).collect()}
    assert {(9 - i, i) for i in range(1, 9)} <= got


def test_last_feature_wins_and_off_grid_parts_are_cut(spark):
    grid = GridSpec(0, 100, 10, 10, 10)
    a = [[(-50, -50), (55, -50), (55, 150), (-50, 150)]]
    b = [[(45, 0), (200, 0), (200, 100), (45, 100)]]
    df = polygons(spark, a, b).selectExpr("*", "concat('p', fid) as code")
    got = {(r["row"], r["col"]): r["code"] for r in raster.burn_attribute(df, grid, "fid", ["code"]).collect()}
    assert len(got) == 100 and got[0, 0] == "p1" and got[5, 4] == "p2" and got[5, 9] == "p2"


def test_ring_area(spark):
    assert polygons(spark, DONUT).select(raster.ring_area("rings").alias("a")).first()["a"] == pytest.approx(178 ** 2 - 80 ** 2)


def test_identical_grid_is_untouched_and_crs_must_agree(grid_of):
    df, grid = grid_of(np.arange(9.0).reshape(3, 3))
    assert raster.align(df, grid, grid, ["value"], "bilinear").collect() == df.collect()
    with pytest.raises(EmberError):
        raster.align(df, grid, GridSpec(0, 75, 25, 3, 3, "other"), ["value"])


def test_align_methods_on_nested_grids(grid_of, to_array):
    a = np.arange(16.0).reshape(4, 4)
    a[0, 0] = np.nan
    df, grid = grid_of(a)
    coarse = GridSpec(0, 100, 50, 2, 2)
    avg = to_array(raster.align(df, grid, coarse, ["value"], "average"), coarse, "value")
    assert avg[0, 0] == pytest.approx((1 + 4 + 5) / 3) and avg[1, 1] == 12.5
    total = to_array(raster.align(df, grid, coarse, ["value"], "sum"), coarse, "value")
    assert np.nansum(total) == np.nansum(a)
    fine = GridSpec(0, 100, 12.5, 8, 8)
    near = to_array(raster.align(df, grid, fine, ["value"], "near"), fine, "value")
    np.testing.assert_array_equal(near, np.kron(a, np.ones((2, 2))))


def test_bilinear_reproduces_a_plane(grid_of, to_array):
    r, c = np.indices((6, 6))
    df, grid = grid_of(2.0 * c + r)
    fine = GridSpec(25, 125, 5, 20, 20)
    got = to_array(raster.align(df, grid, fine, ["value"], "bilinear"), fine, "value")
    x, y = 25 + (np.arange(20) + .5) * 5, 125 - (np.arange(20) + .5) * 5
    want = 2 * (x[None, :] / 25 - .5) + ((150 - y[:, None]) / 25 - .5)
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("target", [GridSpec(-40, 150, 2.5, 80, 60), GridSpec(13, 101, 61, 3, 4), GridSpec(40, 90, 7, 9, 8), GridSpec(500, 90, 7, 9, 8)])
def test_looked_up_by_tiles_as_cell_by_cell(grid_of, to_array, monkeypatch, target):
    monkeypatch.setattr(raster, "REGRID_SIDE", 24)
    rng = np.random.default_rng(2)
    a = rng.random((5, 7))
    a[rng.random(a.shape) < 0.2] = np.nan
    df, grid = grid_of(a)
    sparse = df.filter("row <> 1 or col <> 2")
    a[1, 2] = np.nan
    near = to_array(raster.align(sparse, grid, target, ["value"], "near"), target, "value")
    both = raster.align(sparse, grid, target, ["value"], "bilinear")
    assert both.count() == target.ncell
    smooth = to_array(both, target, "value")
    for r in range(target.nrow):
        for c in range(target.ncol):
            y, x = (grid.ymax - (target.ymax - (r + .5) * target.res)) / 25, (target.xmin + (c + .5) * target.res - grid.xmin) / 25
            inside = 0 <= y < 5 and 0 <= x < 7
            assert near[r, c] == pytest.approx(a[int(np.floor(y)), int(np.floor(x))] if inside else np.nan, nan_ok=True)
            want = np.nan
            if 0 <= y <= 5 and 0 <= x <= 7:
                fy, fx = min(max(y - .5, 0), 4), min(max(x - .5, 0), 6)
                ry, rx = int(fy), int(fx)
                w = [((1 - fy + ry if not i else fy - ry) * (1 - fx + rx if not j else fx - rx), ry + i, rx + j) for i in (0, 1) for j in (0, 1)]
                want = sum(k * a[i, j] for k, i, j in w if k > 0)
            assert smooth[r, c] == pytest.approx(want, nan_ok=True)


def test_near_keeps_types(spark):
    df = spark.createDataFrame([(0, 0, "a"), (1, 1, None)], "row int, col int, name string")
    got = raster.align(df, GridSpec(0, 50, 25, 2, 2), GridSpec(0, 50, 12.5, 4, 4), ["name"], "near")
    assert got.schema["name"].dataType.simpleString() == "string" and got.filter("name = 'a'").count() == 4 and got.count() == 16


def test_average_with_cells_that_straddle(grid_of, to_array):
    df, grid = grid_of(np.array([[0.0, 10.0, 20.0]]))
    target = GridSpec(0, 25, 37.5, 1, 2)
    got = to_array(raster.align(df, grid, target, ["value"], "average"), target, "value")
    assert got[0, 0] == pytest.approx(10 / 3) and got[0, 1] == pytest.approx((10 * 12.5 + 20 * 25) / 37.5)


def test_pick_method_and_scale_gap():
    a, b = GridSpec(0, 100, 25, 4, 4), GridSpec(0, 100, 50, 2, 2)
    assert raster.pick_method(False, a, b) == "average" and raster.pick_method(False, b, a) == "near"
    assert raster.pick_method(True, a, b, "average") == "near"
    gap = raster.scale_gap({"a": a, "b": b}, "coarsest")
    assert gap["target"] == "b" and gap["cells_per_coarse_cell"] == 4


def test_trim_warns_about_a_thin_margin(grid_of, spark):
    df, grid = grid_of(np.ones((10, 10)))
    area = polygons(spark, [[(50, 50), (200, 50), (200, 200), (50, 200)]])
    with pytest.warns(UserWarning, match="margin"):
        kept = raster.trim(df, grid, area, "fid", radius=100, box=(50, 50, 200, 200))
    assert kept.count() == 36


def test_covering_grid_snaps_outward():
    g = GridSpec.covering(3, 7, 51, 80, 25)
    assert (g.xmin, g.ymax, g.nrow, g.ncol) == (0, 100, 4, 3)
