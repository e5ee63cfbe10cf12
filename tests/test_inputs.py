import math

import pytest

from emberline.grid import CELL
from emberline.operators import raster
from emberline.plans import inputs
from emberline.plans.catalog import CATALOG
from emberline.plans.inputs import Inputs

DATA = "/root/testdata/sf0.001"


def steps(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Aggregate" in line]


def test_parts_of_bands_follow_the_grid(spark, monkeypatch):
    monkeypatch.setattr(inputs, "PART_CELLS", 50)
    i = Inputs(spark, DATA)
    bands = i.bands()
    assert bands.rdd.getNumPartitions() == math.ceil(i.grid.ncell / 50) > 4
    assert raster.mosaic(bands, "nir", "tile", ["scene"]).rdd.getNumPartitions() == bands.rdd.getNumPartitions()
    g = spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy("l_linenumber", "l_suppkey", "l_orderkey").count().count()
    assert bands.count() == bands.select("scene", "tile", *CELL).distinct().count() == g


@pytest.mark.parametrize("name, exchanges", [("mosaic_first_tile", 1), ("landcover_raster", 1), ("dnbr_cells", 2)])
def test_lines_are_dealt_by_cell_once_and_not_aggregated_before(spark, name, exchanges):
    got = steps(CATALOG[name](spark, DATA))
    assert sum("Exchange" in s for s in got) == exchanges
    # Each branch ends with its exchange: no hash table of half a scan lies below one.
    assert "Exchange" in got[-1] and not any("Exchange" in a and "Aggregate" in b and len(a) - len(a.lstrip(" :+-|")) < len(b) - len(b.lstrip(" :+-|")) for a, b in zip(got, got[1:]))
