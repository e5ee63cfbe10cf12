"""Pareto fronts over distinct rounded combinations, peeled to a depth or to the end.

Combinations are cut into blocks by quantiles of each dimension.  Whatever lies in a block that is ahead in every dimension
dominates the whole block, so of such blocks one number, their deepest level, is all that a block needs to know: the block
stands below it, and is dropped where that is the last level asked for.  Of the blocks that are level with it in some
dimension and behind in none it needs the combinations of deeper levels only.  Blocks whose cuts add up to the same number
never dominate each other and are ranked side by side, one such wave after the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.errors import BadRange
from emberline.operators.algebra import minmax
from emberline.session import hold

#: Combinations of a block on average, and blocks at most.
BLOCK_ROWS, BLOCKS = 20_000, 4096


def ranked(m: np.ndarray, depth: float, given: np.ndarray | None = None, base: int = 0) -> np.ndarray:
    """Peeling level of each distinct row, 0 beyond ``depth``.  Larger is better.

    Rows sorted best-first can only be dominated by earlier ones, so a level is one more than the deepest earlier row
    that dominates it.  Rows whose level is ``given`` (above 0) have it already.  All rows without one stand below
    ``base`` levels of rows that are not here; rows of deeper levels than that are all here.
    """
    order = np.lexsort(-m.T[::-1])
    s = m[order]
    known = np.zeros(len(s), "int64") if given is None else given[order]
    level = known.copy()
    fronts: list[np.ndarray] = []
    for i, row in enumerate(s):
        if known[i]:
            at = int(known[i]) - base - 1
            if at < 0:
                continue
        else:
            at, hi = 0, len(fronts)
            while at < hi:
                mid = (at + hi) // 2
                if (fronts[mid] >= row).all(axis=1).any():
                    at = mid + 1
                else:
                    hi = mid
            if base + at >= depth:
                continue
            level[i] = base + at + 1
        fronts += [s[:0]] * (at + 1 - len(fronts))
        fronts[at] = np.vstack([fronts[at], row[None, :]])
    out = np.zeros(len(s), dtype="int64")
    out[order] = level
    return out


def front_levels(m: np.ndarray, depth: float) -> np.ndarray:
    """As :func:`ranked`, of rows that are all there is."""
    return ranked(m, depth)


def _cuts_below(cuts: list[float], v: Column) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c <= v)) if cuts else F.lit(0)


def _ranker(keys: list[str], depth: float, bases: dict[int, int]) -> Callable[[tuple[Any, ...], pd.DataFrame], pd.DataFrame]:
    def rank(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        given = pdf["_level"].to_numpy("int64")
        level = ranked(pdf[keys].to_numpy(), depth, given, bases[int(key[0])])
        new = (given == 0) & (level > 0)
        return pdf[keys][new].assign(_block=key[0], _level=level[new])

    return rank


def _levels(alive: DataFrame, keys: list[str], depth: float) -> DataFrame:
    """``keys``, ``_level`` of the distinct combinations ``alive`` that are within ``depth``."""
    spark = alive.sparkSession
    grain = [k / 64 for k in range(1, 64)]
    n, *cuts = alive.agg(F.count("*"), *[F.percentile_approx(k, grain, 10_000) for k in keys]).first()
    side = min(math.floor(BLOCKS ** (1 / len(keys)) + 1e-9), math.ceil((n / BLOCK_ROWS) ** (1 / len(keys))) or 1, 64)
    block = F.lit(0)
    for k, c in zip(keys, cuts, strict=True):
        own = sorted({c[64 * j // side - 1] for j in range(1, side)}) if side > 1 else []
        block = block * side + _cuts_below(own, F.col(k))
    alive = alive.withColumn("_block", block.cast("int"))
    # A row a block, so no more than BLOCKS.
    blocks = np.array(sorted(r[0] for r in alive.select("_block").distinct().collect()) if side > 1 else [0], "int64")
    place = np.stack([blocks // side ** k % side for k in range(len(keys))], axis=1)
    deepest = np.zeros(len(blocks), "int64")
    schema = ", ".join(f"{k} double" for k in keys) + ", _block int, _level long"
    none = spark.createDataFrame([], schema)
    done: list[DataFrame] = []
    for wave in sorted(set(place.sum(axis=1).tolist()), reverse=True):
        bases, pairs = {}, []
        for j in np.flatnonzero(place.sum(axis=1) == wave).tolist():
            ahead = (place > place[j]).all(axis=1)
            base = int(deepest[ahead].max(initial=0))
            if base < depth:
                bases[int(blocks[j])] = base
                beside = (place >= place[j]).all(axis=1) & ~ahead & (deepest > base)
                pairs += [(int(blocks[i]), int(blocks[j]), base) for i in np.flatnonzero(beside)]
        if not bases:
            continue
        met = alive.filter(F.col("_block").isin(*bases)).select(*keys, "_block", F.lit(0).cast("long").alias("_level"))
        if pairs:
            earlier = none
            for d in done:
                earlier = earlier.union(d)
            sent = spark.createDataFrame(pairs, "_from int, _to int, _base long")
            met = met.union(earlier.join(sent, F.col("_block") == F.col("_from")).filter("_level > _base").select(
                *keys, F.col("_to").alias("_block"), "_level"))
        done.append(hold(met.groupBy("_block").applyInPandas(_ranker(keys, depth, bases), schema), "front-levels"))
        for b, top in done[-1].groupBy("_block").agg(F.max("_level")).collect():
            deepest[np.searchsorted(blocks, b)] = top
    out = none
    for d in done:
        out = out.union(d)
    return out.select(*keys, "_level")


def pareto(cells: DataFrame, dims: list[str], depth: float = 1, digits: int = 3,
           normalise: str = "minmax", out: str = "risk") -> DataFrame:
    """Front membership (depth 1) or peeled score of every complete cell.

    Combinations are rounded and made distinct.  With a depth they are first pruned part by part: a combination's level
    within any part never exceeds its level overall, so what a part puts beyond the depth is beyond it.  What is left
    is ranked block by block; without a depth that is all.  Cells with a missing dimension stay null.
    """
    if depth < 1:
        raise BadRange("depth must be at least 1")
    base = cells
    keys = [f"_k{i}" for i in range(len(dims))]
    base = base.withColumns({k: F.col(d).cast("double") for k, d in zip(keys, dims)})
    if normalise == "minmax":
        base = minmax(base, keys)
    base = base.withColumns({k: F.bround(k, digits) for k in keys})
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    schema = ", ".join(f"{k} double" for k in keys)

    def pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Best first within what fits in memory; the dominated go as they come."""
        held = None
        for pdf in batches:
            both = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = both[front_levels(both.to_numpy(), depth) > 0]
        if held is not None and len(held):
            yield held

    alive = base.filter(complete).select(*keys).distinct()
    if math.isfinite(depth):
        alive = alive.mapInPandas(pruned, schema)
    levels = _levels(hold(alive, "front-combinations"), keys, depth)
    if depth == 1:
        scored = levels.select(*keys, F.lit(1.0).alias(out))
    else:
        top = F.lit(levels.agg(F.max("_level")).first()[0])
        scored = levels.select(*keys, ((top - F.col("_level") + 1) / top).alias(out))
    joined = base.join(scored, keys, "left")
    value = F.when(complete, F.coalesce(out, F.lit(0.0)))
    return joined.withColumn(out, value).drop(*keys)
