import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from emberline.operators import rank
from pyspark.sql import functions as F


def table(spark, values, **more):
    pdf = pd.DataFrame({"v": np.asarray(values, dtype="float64"), **more})
    return spark.createDataFrame(pdf).selectExpr("nullif(v, double('NaN')) as v", *more)


def test_mid_rank_with_one_value_holding_a_third(spark):
    rng = np.random.default_rng(0)
    v = np.r_[np.zeros(1000), rng.normal(size=2000)]
    got = rank.mid_rank(table(spark, v, i=np.arange(len(v))), "v").toPandas().sort_values("i")
    np.testing.assert_allclose(got["rank"], pd.Series(v).rank())


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_cumulative_does_not_depend_on_ranges(spark, ranges):
    df = table(spark, np.arange(300) % 97, n=np.ones(300, dtype="int64")).groupBy("v").sum("n").withColumnRenamed("sum(n)", "n")
    got = rank.cumulative(df, "v", ["n"], ranges=ranges).toPandas().sort_values("v")
    np.testing.assert_array_equal(got["n_before"], np.r_[0, np.cumsum(got["n"])[:-1]])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    probs = [0, 0.1, 0.5, 0.98, 1]
    got = {r["prob"]: r["q"] for r in rank.quantiles(table(spark, values), "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9)


def test_quantiles_by_group_ignore_nulls(spark):
    df = table(spark, [1, 2, np.nan, 10, 20, 30], g=["a", "a", "a", "b", "b", "b"])
    got = {r["g"]: (r["q"], r["n"]) for r in rank.quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"a": (1.5, 2), "b": (20, 3)}


@pytest.mark.parametrize("scores,want", [([1, 2, 3, 4], 1.0), ([4, 3, 2, 1], 0.0), ([1, 1, 1, 1], 0.5)])
def test_auc_extremes(spark, scores, want):
    df = table(spark, scores, hit=[False, False, True, True])
    assert rank.auc(df, "v", "hit").first()["auc"] == want


def test_auc_of_one_class_is_null(spark):
    assert rank.auc(table(spark, [1, 2], hit=[True, True]), "v", "hit").first()["auc"] is None


def test_percentile_rank_conventions(spark):
    df = table(spark, [10, 20, 20, 40, np.nan])
    a = rank.percentile_rank(df, "v", "centred").toPandas().set_index("v")["pr"]
    assert a[10] == pytest.approx(0.125) and a[40] == pytest.approx(0.875)
    b = rank.percentile_rank(df, "v", "spread").toPandas().set_index("v")["pr"]
    assert b[10] == 0 and b[40] == 1 and list(b[20]) == [0.5, 0.5]
    assert rank.percentile_rank(table(spark, [7.0]), "v", "spread").first()["pr"] == 1


def test_share_counts_reference_rows_only(spark):
    df = table(spark, [1, 2, 3, 5, np.nan], ref=[True, True, False, True, True], g=[1] * 5)
    got = rank.share_at_or_below(df.selectExpr("v", "ref and v is not null as ref", "g"), "v", "ref", ["g"]).toPandas()
    got = got.set_index("v")["percentile"]
    assert got[3.0] == pytest.approx(200 / 3) and got[5.0] == 100 and got[np.nan:].isna().all()


def test_a_value_on_half_of_the_rows_is_no_hot_task(spark):
    n = 40_000
    rng = np.random.default_rng(1)
    v = np.where(np.arange(n) % 2 == 0, 7.0, rng.integers(0, 9000, n) / 10)
    v[1::50] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "v": v})).withColumn("v", F.nullif("v", F.lit(float("nan"))))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = rank.mid_rank(df, "v", out="r")
        sizes = sorted(r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect())
        got = ranked.orderBy("i").toPandas()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    np.testing.assert_allclose(got["r"], pd.Series(v).rank(method="average"))
    assert set(got["r_n"].dropna()) == {int(np.isfinite(v).sum())}
