"""Stacks on disk: layers, geometry and record written and read together."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.errors import EmptyResult, UnknownName
from emberline.grid import CELL, GridSpec, Layer
from emberline.operators.provenance import Provenance


def save_stack(stack: dict[str, Layer], path: str) -> None:
    """Write layers in long form under their name, with a small text side file.

    Layers need not share a grid.  The side file goes through Spark too, so any file
    system the cluster knows will do.
    """
    if not stack:
        raise EmptyResult("a stack needs at least one layer")
    meta, cells = {}, None
    for name, layer in stack.items():
        part = layer.df.select(F.lit(name).alias("layer"), *CELL, F.col(layer.value).cast("double").alias("value"))
        cells = part if cells is None else cells.unionByName(part)
        meta[name] = {"grid": asdict(layer.grid), "role": layer.role, "units": layer.units,
                      "sources": list(layer.prov.sources), "steps": list(layer.prov.steps)}
    cells.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/cells")
    side = cells.sparkSession.range(1).select(F.lit(json.dumps(meta)).alias("value"))
    side.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_stack(spark: SparkSession, path: str) -> dict[str, Layer]:
    """Read a stack back; a layer is one pruned partition of the table."""
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    cells = spark.read.parquet(f"{path}/cells")
    have = {r[0] for r in cells.select("layer").distinct().collect()}
    lacking = set(meta) - have
    if lacking:
        raise UnknownName(f"the side file names layers without cells: {sorted(lacking)}")
    out = {}
    for name, m in meta.items():
        prov = Provenance(tuple(m["sources"]), tuple(m["steps"]))
        df = cells.filter(F.col("layer") == name).select(*CELL, "value")
        out[name] = Layer(df, GridSpec(**m["grid"]), "value", m["role"], m["units"], prov)
    return out


def append_records(records: DataFrame, path: str, by: str = "run") -> None:
    """Append provenance rows of many runs, kept apart by run so that one run is one pruned folder."""
    records.write.mode("append").partitionBy(by).parquet(path)


def write_provenance(spark: SparkSession, prov: Provenance, run: str, path: str) -> None:
    """Append a run's sources and steps to tables that can be queried across runs."""
    append_records(prov.sources_df(spark).withColumn("run", F.lit(run)), f"{path}/sources")
    append_records(prov.steps_df(spark).withColumn("run", F.lit(run)), f"{path}/steps")


def write_cells(cells: DataFrame, path: str, band: int = 1024) -> None:
    """Stream a result to disk in bands of rows, so a later window read prunes files."""
    banded = cells.withColumn("band", F.expr(f"row div {int(band)}"))
    banded.repartitionByRange("band", "row", "col").write.mode("overwrite").partitionBy("band").parquet(path)
