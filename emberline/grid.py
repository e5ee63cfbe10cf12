"""Grid geometry kept on the driver, and the layer record that carries it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.errors import GridMismatch
from emberline.operators.provenance import Provenance

CELL = ["row", "col"]


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid of square cells; row 0 is the northern edge."""

    xmin: float
    ymax: float
    res: float
    nrow: int
    ncol: int
    crs: str = ""

    @property
    def ncell(self) -> int:
        return self.nrow * self.ncol

    @property
    def xmax(self) -> float:
        return self.xmin + self.ncol * self.res

    @property
    def ymin(self) -> float:
        return self.ymax - self.nrow * self.res

    @property
    def cell_ha(self) -> float:
        return self.res * self.res / 1e4

    @classmethod
    def covering(cls, xmin: float, ymin: float, xmax: float, ymax: float, res: float, crs: str = "") -> GridSpec:
        """Smallest grid over a box, its edges snapped outward to multiples of ``res``."""
        x0, y1 = math.floor(xmin / res) * res, math.ceil(ymax / res) * res
        ncol = max(1, round((math.ceil(xmax / res) * res - x0) / res))
        nrow = max(1, round((y1 - math.floor(ymin / res) * res) / res))
        return cls(x0, y1, res, nrow, ncol, crs)

    def x(self, col="col") -> Column:
        return F.lit(self.xmin) + (_c(col) + F.lit(0.5)) * F.lit(float(self.res))

    def y(self, row="row") -> Column:
        return F.lit(self.ymax) - (_c(row) + F.lit(0.5)) * F.lit(float(self.res))

    def col_of(self, x) -> Column:
        return F.floor((_c(x) - F.lit(float(self.xmin))) / F.lit(float(self.res))).cast("int")

    def row_of(self, y) -> Column:
        return F.floor((F.lit(float(self.ymax)) - _c(y)) / F.lit(float(self.res))).cast("int")

    def inside(self, row="row", col="col") -> Column:
        return _c(row).between(0, self.nrow - 1) & _c(col).between(0, self.ncol - 1)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid, generated where it is used."""
        return spark.range(self.ncell).select(
            F.expr(f"id div {self.ncol}").cast("int").alias("row"),
            F.expr(f"id % {self.ncol}").cast("int").alias("col"),
        )

    def complete(self, cells: DataFrame) -> DataFrame:
        """Add the absent cells of a sparse table as explicit nulls."""
        return self.cells(cells.sparkSession).join(cells, CELL, "left")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_same_grid(**grids: GridSpec) -> GridSpec:
    """Refuse layers on different grids; compares metadata only, runs no job."""
    names = list(grids)
    first = grids[names[0]]
    for name in names[1:]:
        if grids[name] != first:
            raise GridMismatch(f"'{name}' is not on the grid of '{names[0]}': {grids[name]} against {first}; align first")
    return first


@dataclass(frozen=True)
class Layer:
    """Cells plus what they mean: grid, role, units and how they were made."""

    df: DataFrame
    grid: GridSpec
    value: str = "value"
    role: str = ""
    units: str = ""
    prov: Provenance = field(default_factory=Provenance)

    def column(self, name: str) -> DataFrame:
        return self.df.select(*CELL, F.col(self.value).alias(name))

    def derive(self, df: DataFrame, value: str, fun: str, params: dict, **changes) -> Layer:
        prov = self.prov.step(fun, params)
        return replace(self, df=df, value=value, prov=prov, **changes)


def join_layers(**layers: Layer) -> tuple[DataFrame, GridSpec]:
    """Same-grid layers side by side, one column per layer name."""
    grid = require_same_grid(**{k: v.grid for k, v in layers.items()})
    out = None
    for name, layer in layers.items():
        part = layer.column(name)
        out = part if out is None else out.join(part, CELL, "full")
    return out, grid
