"""Connected null gaps, and the repair of those too small to be real."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import BadRange, EmberWarning, notice
from emberline.functions.constants import MAPPING_UNIT_HA
from emberline.grid import CELL, GridSpec
from emberline.session import cut_lineage

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FORWARD = [(0, 1), (1, -1), (1, 0), (1, 1)]


def _label_tile(rows: np.ndarray, cols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest cell id of each cell's 8-connected piece within one tile."""
    r, c = rows - rows.min() + 1, cols - cols.min() + 1
    at = np.full((r.max() + 2, c.max() + 2), -1, dtype="int64")
    at[r, c] = np.arange(len(r))
    pairs = []
    for dy, dx in FORWARD:
        other = at[r + dy, c + dx]
        mine = np.flatnonzero(other >= 0)
        pairs.append(np.stack([mine, other[mine]]))
    a, b = np.concatenate(pairs, axis=1)
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        root = label[np.searchsorted(ids, label)]
        label = np.minimum(label, root)
        if np.array_equal(before, label):
            return label


def min_label(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph (columns ``a``, ``b``).

    Alternates hooking every node to its smallest neighbour with shortcutting to the
    neighbour's own label, which closes long chains in logarithmically many rounds.
    Each round is checkpointed, so lineage stays short and a lost executor costs little.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        hooked = both.join(seen, "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(hooked, labels["node"] == hooked["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = step.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        step = cut_lineage(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")))
        changed = step.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def null_components(cells: DataFrame, grid: GridSpec, value: str, side: int = 256) -> DataFrame:
    """8-connected pieces of null cells: (row, col, component, size).

    Only null cells enter.  Each tile labels its own; pieces that touch across tile
    borders are then merged through the much smaller graph of border contacts.
    ``cells`` must list its null cells as rows.
    """
    ident = (F.col("row").cast("long") * grid.ncol + F.col("col")).alias("id")
    gaps = cells.filter(F.col(value).isNull()).select(*CELL, ident)
    tiled = gaps.withColumn("tr", F.expr(f"row div {side}")).withColumn("tc", F.expr(f"col div {side}"))

    def label(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        piece = _label_tile(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["id"].to_numpy())
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "piece": piece})

    local = cut_lineage(tiled.groupBy("tr", "tc").applyInPandas(label, "row int, col int, piece long"))
    pieces = local.groupBy("piece").agg(F.count("*").alias("n"))
    border = local.filter(
        (F.col("row") % side).isin(0, side - 1) | (F.col("col") % side).isin(0, side - 1))
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in FORWARD])
    reach = border.select("row", "col", "piece", F.explode(moves).alias("m")).select(
        (F.col("row") + F.col("m.dy")).alias("row"), (F.col("col") + F.col("m.dx")).alias("col"),
        F.col("piece").alias("a"))
    edges = reach.join(border.withColumnRenamed("piece", "b"), CELL).filter("a <> b").select("a", "b").distinct()
    edges = cut_lineage(edges)
    if edges.isEmpty():
        merged = pieces.withColumn("component", F.col("piece"))
    else:
        roots = min_label(edges).withColumnRenamed("node", "piece")
        merged = pieces.join(roots, "piece", "left").select("piece", "n", F.coalesce("label", "piece").alias("component"))
    # sizes are summed over pieces, and cells meet their piece only: one sea is many pieces of a tile's size at most
    sizes = merged.groupBy("component").agg(F.sum("n").alias("size"))
    named = merged.join(sizes, "component").select("piece", "component", "size")
    return local.join(named, "piece").select(*CELL, "component", "size")


def mapping_unit(components: list[str]) -> tuple[float | None, str]:
    """Largest mapping unit among the complete-coverage sources, and why there may be none."""
    known = {c: MAPPING_UNIT_HA[c] for c in components if c in MAPPING_UNIT_HA}
    if not known:
        return None, "partial coverage: silence of a source may be information"
    areas = [a for a in known.values() if a is not None]
    return (max(areas), "mapping unit") if areas else (None, "natively raster: every hole is real")


def modal_fill(ids: np.ndarray, codes: np.ndarray, target: np.ndarray, width: int, passes: int) -> np.ndarray:
    """Repeated 3x3 mode over unknown target cells; ties go to the lowest code.

    Cells are given sparsely by sorted id on rows of ``width`` cells.  Code 0 means
    unknown; every pass reads the state the last one left.
    """
    codes = codes.copy()
    for _ in range(passes):
        todo = np.flatnonzero(target & (codes == 0))
        if not len(todo):
            break
        row, col = ids[todo] // width, ids[todo] % width
        near = np.zeros((len(AROUND), len(todo)), dtype="int64")
        for k, (dy, dx) in enumerate(AROUND):
            want = (row + dy) * width + col + dx
            at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
            ok = (ids[at] == want) & (col + dx >= 0) & (col + dx < width)
            near[k] = np.where(ok, codes[at], 0)
        near.sort(axis=0)
        count = (near[:, None, :] == near[None, :, :]).sum(axis=1) * (near > 0)
        best = near[count.argmax(axis=0), np.arange(len(todo))]
        if not best.any():
            break
        codes[todo] = best
    return codes


def fill_gaps(
    cells: DataFrame,
    grid: GridSpec,
    value: str = "class",
    source: str | None = None,
    max_gap_ha: float | None = None,
    components: list[str] | None = None,
) -> DataFrame:
    """Fill null gaps no source could have mapped by the modal neighbour class.

    Gaps up to the limit are filled, larger ones stay.  Other columns are untouched,
    except that ``source`` is stamped ``gap_filled``.  A gap sees only the cells right
    around it, and two gaps never touch, so just those cells are taken from the grid
    and gaps are repaired in independent groups of even size.
    """
    if max_gap_ha is None:
        max_gap_ha, why = mapping_unit(components or [])
        if max_gap_ha is None:
            notice(f"nothing filled: {why}", EmberWarning)
            return cells
    if max_gap_ha <= 0:
        raise BadRange("max_gap_ha must be positive")
    limit = max_gap_ha / grid.cell_ha
    small = cut_lineage(null_components(cells, grid, value).filter(F.col("size") <= limit))
    biggest, n_small = small.agg(F.max("size"), F.count("*")).first()
    if biggest is None:
        notice("nothing filled: no gap is below the limit", EmberWarning)
        return cells
    passes = math.ceil(math.sqrt(biggest)) + 1
    groups = math.ceil(n_small / 50_000)
    width = grid.ncol

    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [(0, 0), *AROUND]])
    group = F.pmod(F.hash("component"), F.lit(groups)).alias("group")
    patch = small.select("row", "col", group, F.explode(moves).alias("m")).groupBy(
        (F.col("row") + F.col("m.dy")).alias("row"), (F.col("col") + F.col("m.dx")).alias("col"), "group").agg(
        F.max((F.col("m.dy") == 0) & (F.col("m.dx") == 0)).alias("gap"))
    near = patch.join(cells.select(*CELL, F.col(value).alias("v")), CELL)

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["row"].to_numpy(dtype="int64") * width + pdf["col"].to_numpy()
        order = np.argsort(ids)
        names = sorted(pdf["v"].dropna().unique())
        code = pd.Categorical(pdf["v"], categories=names).codes.astype("int64") + 1
        gap = pdf["gap"].to_numpy(dtype=bool)
        done = np.zeros(len(pdf), dtype="int64")
        done[order] = modal_fill(ids[order], code[order], gap[order], width, passes)
        new = gap & (done > 0)
        return pd.DataFrame({"row": pdf["row"][new], "col": pdf["col"][new],
                             "filled": np.array(names, dtype=object)[done[new] - 1]})

    filled = near.groupBy("group").applyInPandas(repair, "row int, col int, filled string")
    out = cells.join(filled, CELL, "left").withColumn(value, F.coalesce(value, "filled"))
    if source is not None:
        out = out.withColumn(source, F.when(F.col("filled").isNotNull(), F.lit("gap_filled")).otherwise(F.col(source)))
    return out.drop("filled")
