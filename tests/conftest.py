import numpy as np
import pandas as pd
import pytest

from emberline.grid import GridSpec
from emberline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid_of(spark):
    """A cell table from a 2-D array; NaN becomes null."""
    def make(a, res=25.0, name="value"):
        a = np.asarray(a, dtype="float64")
        r, c = np.indices(a.shape)
        pdf = pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), name: a.ravel()})
        df = spark.createDataFrame(pdf).selectExpr("row", "col", f"nullif({name}, double('NaN')) as {name}")
        return df, GridSpec(0.0, a.shape[0] * res, res, *a.shape)

    return make


@pytest.fixture(scope="session")
def to_array():
    def read(df, grid, name):
        out = np.full((grid.nrow, grid.ncol), np.nan)
        for r in df.select("row", "col", name).collect():
            out[r[0], r[1]] = np.nan if r[2] is None else r[2]
        return out

    return read
