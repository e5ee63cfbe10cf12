import numpy as np
import pytest

from emberline.operators import components


def flood(mask):
    label = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask)):
        if label[start] >= 0:
            continue
        ident, todo = start[0] * mask.shape[1] + start[1], [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and label[r, c] < 0:
                label[r, c] = ident
                todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return label


def check(grid_of, to_array, mask, side):
    df, grid = grid_of(np.where(mask, np.nan, 1.0))
    got = to_array(components.null_components(df, grid, "value", side), grid, "component")
    np.testing.assert_array_equal(np.where(mask, got, -1), flood(mask))


@pytest.mark.parametrize("share", [0.2, 0.45])
def test_components_match_flood_fill(grid_of, to_array, share):
    mask = np.random.default_rng(5).random((30, 37)) < share
    check(grid_of, to_array, mask, 6)


def test_snake_through_many_tiles(grid_of, to_array):
    mask = np.zeros((33, 33), dtype=bool)
    mask[::4] = True
    for k, r in enumerate(range(0, 32, 4)):
        mask[r:r + 5, -1 if k % 2 == 0 else 0] = True
    check(grid_of, to_array, mask, 4)


def test_sizes(grid_of, spark):
    a = np.ones((10, 10))
    a[1, 1] = a[2, 2] = a[8, 8] = np.nan
    df, grid = grid_of(a)
    got = {(r["row"], r["col"]): r["size"] for r in components.null_components(df, grid, "value").collect()}
    assert got == {(1, 1): 2, (2, 2): 2, (8, 8): 1}


def classes(grid_of, a):
    df, grid = grid_of(a)
    return df.selectExpr("row", "col", "cast(cast(value as int) as string) as class", "'survey' as source"), grid


def test_fill_takes_the_mode_and_leaves_large_gaps(grid_of, spark):
    a = np.full((12, 12), 5.0)
    a[:, 6:] = 7.0
    a[3, 3] = np.nan
    a[7:11, 7:11] = np.nan
    cells, grid = classes(grid_of, a)
    got = {(r["row"], r["col"]): r for r in components.fill_gaps(cells, grid, source="source", max_gap_ha=4 * grid.cell_ha).collect()}
    assert (got[3, 3]["class"], got[3, 3]["source"]) == ("5", "gap_filled")
    assert got[8, 8]["class"] is None and got[8, 8]["source"] == "survey"
    assert all(got[r, c]["class"] == str(int(a[r, c])) for r, c in got if not np.isnan(a[r, c]))


def dense_fill(codes, passes):
    ids = np.arange(codes.size)
    return components.modal_fill(ids, codes.ravel(), codes.ravel() == 0, codes.shape[1], passes).reshape(codes.shape)


def test_ties_go_to_the_lowest_class_and_passes_reach_inside():
    assert dense_fill(np.array([[1, 2, 1], [2, 0, 1], [2, 1, 2]]), 1)[1, 1] == 1
    wide = np.full((7, 7), 3)
    wide[2:5, 2:5] = 0
    assert (dense_fill(wide, 4) == 3).all()
    edge = np.array([[0, 1, 2], [5, 1, 0]])
    assert dense_fill(edge, 1)[0, 0] == 1 and dense_fill(edge, 1)[1, 2] == 1


def test_fill_crosses_tile_borders(grid_of, to_array, monkeypatch):
    a = np.full((300, 9), 2.0)
    a[127:129, 4] = np.nan
    cells, grid = classes(grid_of, a)
    got = components.fill_gaps(cells, grid, max_gap_ha=4 * grid.cell_ha)
    assert got.filter("class is null").count() == 0


def test_no_fill_without_complete_coverage(grid_of):
    a = np.full((12, 12), 5.0)
    a[3, 3] = np.nan
    cells, grid = classes(grid_of, a)
    for parts in (["bdforet_v2"], ["worldcover_2021"]):
        assert components.fill_gaps(cells, grid, components=parts).filter("class is null").count() == 1
    assert components.fill_gaps(cells, grid, components=["clc_2018"]).filter("class is null").count() == 0
