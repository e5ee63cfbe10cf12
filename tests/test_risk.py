import numpy as np
import pandas as pd
import pytest

from emberline.errors import BadRange, BadWeights, EmberError, GridMismatch, RoleRefused
from emberline.functions import scalars
from emberline.grid import GridSpec, Layer, join_layers, require_same_grid
from emberline.operators import algebra, classify, skyline
from pyspark.sql import functions as F


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    pdf = pd.DataFrame({"row": np.zeros(n, dtype="int32"), "col": np.arange(n, dtype="int32"), **cols})
    df = spark.createDataFrame(pdf)
    return df.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def column(df, name):
    return [r[0] for r in df.orderBy("col").select(name).collect()]


def levels_by_peeling(m, depth):
    level, left, k = np.zeros(len(m), dtype=int), np.arange(len(m)), 1
    while len(left) and k <= depth:
        s = m[left]
        dominated = np.array([((s >= row).all(1) & (s > row).any(1)).any() for row in s])
        level[left[~dominated]] = k
        left, k = left[dominated], k + 1
    return level


@pytest.mark.parametrize("dims", [2, 3, 4])
@pytest.mark.parametrize("depth", [1, 3, np.inf])
def test_front_levels_match_peeling(dims, depth):
    m = np.unique(np.random.default_rng(dims).integers(0, 9, (300, dims)), axis=0).astype(float)
    m = m[np.random.default_rng(0).permutation(len(m))]
    np.testing.assert_array_equal(skyline.front_levels(m, depth), levels_by_peeling(m, depth))


def test_pruning_by_partition_keeps_levels(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 200, 6000) / 199, rng.integers(0, 200, 6000) / 199
    got = skyline.pareto(frame(spark, a=a, b=b), ["a", "b"], depth=3, digits=6, normalise="none").orderBy("col").toPandas()
    m = np.round(np.c_[a, b], 6)
    uniq, back = np.unique(m, axis=0, return_inverse=True)
    lev = levels_by_peeling(uniq, 3)[back.ravel()]
    np.testing.assert_allclose(got["risk"], np.where(lev == 0, 0, (3 - lev + 1) / 3))


@pytest.mark.parametrize("depth", [3, np.inf])
@pytest.mark.parametrize("shape", ["cube", "diagonal", "antichain"])
def test_blocks_in_waves_give_the_same_levels(spark, monkeypatch, depth, shape):
    monkeypatch.setattr(skyline, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(4)
    m = rng.integers(0, 12, (900, 3)) / 11
    if shape == "diagonal":
        m = np.clip(np.round(rng.random(700)[:, None] + rng.normal(0, 0.03, (700, 3)), 2), 0, 1)
    elif shape == "antichain":
        m[:, 2] = np.round(1 - (m[:, 0] + m[:, 1]) / 2, 6)
    m = np.round(m, 6)
    got = skyline.pareto(frame(spark, a=m[:, 0], b=m[:, 1], c=m[:, 2]), ["a", "b", "c"], depth=depth, digits=6, normalise="none").orderBy("col").toPandas()
    uniq, back = np.unique(m, axis=0, return_inverse=True)
    lev = levels_by_peeling(uniq, depth)[back.ravel()]
    np.testing.assert_allclose(got["risk"], np.where(lev == 0, 0, (lev.max() - lev + 1) / lev.max()))


def test_pareto_nulls_and_guard(spark):
    df = frame(spark, a=[0.0, 1.0, np.nan, 1.0], b=[1.0, 0.0, 1.0, 1.0])
    assert column(skyline.pareto(df, ["a", "b"]), "risk") == [0.0, 0.0, None, 1.0]
    with pytest.raises(BadRange):
        skyline.pareto(df, ["a", "b"], depth=0)


def test_unlimited_depth_scores_every_level(spark):
    df = frame(spark, a=[0.0, 0.5, 1.0], b=[0.0, 0.5, 1.0])
    assert column(skyline.pareto(df, ["a", "b"], depth=float("inf")), "risk") == pytest.approx([1 / 3, 2 / 3, 1])


def test_minimum_keeps_null_and_maximum_skips_it(spark):
    d, a = frame(spark, danger=[0.2, np.nan]), frame(spark, availability=[0.5, 0.5])
    assert column(algebra.danger_index(d, a, method="min"), "index") == [0.2, None]
    both = frame(spark, x=[0.2, np.nan], y=[0.1, 0.4])
    assert column(algebra.weighted_stack(both, ["x", "y"], method="max"), "vulnerability") == [0.2, 0.4]
    assert column(algebra.weighted_stack(both, ["x", "y"], [0.5, 0.5]), "vulnerability")[1] is None


def test_availability_joins_every_day_of_a_series(spark):
    days = frame(spark, danger=[0.2, 0.4]).crossJoin(spark.range(3).withColumnRenamed("id", "day"))
    out = algebra.danger_index(days, frame(spark, availability=[1.0, 0.5]))
    assert out.count() == 6


def test_range_guards(spark):
    flat = frame(spark, v=[3.0, 3.0])
    with pytest.raises(Exception, match="constant"):
        algebra.minmax(flat, ["v"]).collect()
    with pytest.raises(Exception, match="entirely null"):
        algebra.minmax(frame(spark, v=[np.nan, np.nan]), ["v"]).collect()
    with pytest.raises(Exception, match="negative"):
        algebra.vulnerability_layer(frame(spark, v=[-1.0, 3.0]), "v", "log").collect()
    with pytest.raises(BadRange):
        algebra.check_unit_range(frame(spark, v=[0.5, 1.5]), ["v"])
    assert column(algebra.load_weight(flat, "v"), "availability") == [1.0, 1.0]


def test_weights_must_add_up():
    for bad in ([0.5, 0.6], [1.0], [-0.5, 1.5]):
        with pytest.raises(BadWeights):
            algebra.check_weights(bad, 2)


def test_roles_decide_normalisation(spark):
    df = frame(spark, v=[50.0, 100.0])
    assert column(algebra.normalise_danger(df, "v", "auto", "fwi_percentile"), "v") == [0.5, 1.0]
    with pytest.raises(RoleRefused):
        algebra.normalise_danger(df, "v", "auto", "fwi")
    with pytest.raises(RoleRefused):
        classify.danger_class(df, "v", role="fwi_percentile")
    with pytest.raises(Exception, match="must lie"):
        algebra.normalise_danger(frame(spark, v=[101.0]), "v", "percentile").collect()


def test_class_edges(spark):
    df = frame(spark, v=[11.1, 11.2, 70.0, np.nan])
    assert column(classify.danger_class(df, "v"), "danger_class") == ["Low", "Moderate", "Very Extreme", None]
    edges = frame(spark, v=[0.0, 0.2, 0.4, 0.41, 1.0, 1.3])
    assert column(edges.withColumn("b", classify.score_bin("v", [0.2, 0.4, 1.0])), "b") == [1, 2, 2, 3, 3, 3]
    bands = frame(spark, v=[1.0, 2.0, 2.5, 4.0, 4.5])
    assert column(bands.withColumn("b", classify.right_closed_band("v", [1.0, 2.0, 4.0])), "b") == [1, 1, 2, 2, None]
    with pytest.raises(EmberError):
        classify.scheme("effis", breaks=[2, 1], labels=["a", "b", "c"])


def test_crown_fire_published_values(spark):
    row = spark.range(1).select(
        scalars.crown_ignition_intensity(F.lit(3.0), F.lit(100.0)).alias("i0"), scalars.crown_spread_rate(F.lit(0.2)).alias("r0"),
        scalars.byram_intensity(F.lit(1.0), F.lit(10.0)).alias("i")).first()
    assert row["i0"] == pytest.approx(875.2, abs=0.1) and row["r0"] == pytest.approx(15.0) and row["i"] == 3000


def test_humidity_keeps_dew_point(spark):
    got = spark.range(1).select(
        scalars.rh_at_temperature(F.lit(20.0), F.lit(50.0), F.lit(20.0)).alias("same"),
        scalars.rh_at_temperature(F.lit(20.0), F.lit(50.0), F.lit(10.0)).alias("cold")).first()
    assert got["same"] == pytest.approx(50) and 90 < got["cold"] <= 100


def test_grid_mismatch_is_an_error(spark):
    a = GridSpec(0, 100, 25, 4, 4)
    with pytest.raises(GridMismatch):
        require_same_grid(a=a, b=GridSpec(0, 100, 50, 2, 2))
    df = frame(spark, value=[1.0, 2.0])
    both, grid = join_layers(x=Layer(df, a), y=Layer(df, a))
    assert grid == a and both.columns == ["row", "col", "x", "y"] and both.count() == 2
