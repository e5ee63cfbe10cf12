"""Registered queries: a Spark plan over the derived inputs and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.inputs import Inputs


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    row: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Inputs(spark, sf_dir)))


CATALOG: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals, so that two engines' last bits do not matter."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def query(name: str, row: str, sql: str | None = None):
    """Register a query under the operator row it covers."""
    def add(fn: Callable[[Inputs], DataFrame]):
        if name in CATALOG:
            raise KeyError(name)
        CATALOG[name] = Query(fn, sql, row)
        return fn

    return add
