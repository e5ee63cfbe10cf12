"""Exact top-k search by inner product, by MaxScore over shards.

A vector's components are its terms.  Each shard knows every term's least and greatest value, which bounds what a term can
add to a query's score.  A query meets a first shard, whose k-th best score is its bar everywhere else.  Terms whose
bounds together stay under the bar are non-essential: no row reaches it on them alone.  The essential terms' postings
are traversed block by block; a row is probed on the others, widest bound first, only while its score so far and what
these can still add reach the bar.  The bar rises with what a block brings, and the essential set shrinks with it.
Shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import hold

#: Values of a shard, queries of a block, and rows between two looks at the bar.
SHARD_VALUES, BLOCK_QUERIES, BLOCK_ROWS = 1 << 20, 4096, 2048
#: Terms probed between two looks at the bound.
PROBED = 4
#: Whole numbers that double precision adds without rounding.
EXACT = 2.0 ** 53
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and the integer vector floor(scale * x); rows with a null or non-finite component are left out."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & sound).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))


def essential_terms(spread: np.ndarray, order: np.ndarray, needed: float) -> tuple[np.ndarray, np.ndarray]:
    """Essential terms, and the others by falling bound: the most terms whose bounds together stay under ``needed``."""
    cut = int(np.searchsorted(np.cumsum(spread[order]), needed, side="left"))
    return order[cut:], order[:cut][::-1]


def best_of_shard(query: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int,
                  bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the shard's k best rows that reach ``bar``, ties to smaller ids.

    ``low`` and ``high`` are the shard's least and greatest value of each term.
    """
    least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    spread, bottom = most - least, least.sum()
    order = np.argsort(spread, kind="stable")
    best, score = np.zeros(0, "int64"), np.zeros(0, rows.dtype)
    for a in range(0, len(rows), BLOCK_ROWS):
        block = rows[a:a + BLOCK_ROWS]
        essential, others = essential_terms(spread, order, bar - bottom)
        so_far = block[:, essential] @ query[essential]
        left = most[others].sum()
        alive = np.flatnonzero((so_far + left >= bar) & (ids[a:a + BLOCK_ROWS] != own))
        so_far = so_far[alive]
        for j in range(0, len(others), PROBED):
            if not len(alive):
                break
            terms = others[j:j + PROBED]
            so_far = so_far + block[np.ix_(alive, terms)] @ query[terms]
            left -= most[terms].sum()
            keep = so_far + left >= bar
            if not keep.all():
                alive, so_far = alive[keep], so_far[keep]
        best, score = np.concatenate([best, alive + a]), np.concatenate([score, so_far])
        if len(best) > k:
            first = np.lexsort((ids[best], -score))[:k]
            best, score = best[first], score[first]
        if len(best) == k:
            bar = max(bar, score.min())
    first = np.lexsort((ids[best], -score))
    return best[first], score[first]


def _each(n: int, name: str) -> Column:
    """One row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best partners of each row whose id is divisible by ``every``.

    All rows but those of the query's own id are candidates.  Vectors that are null or hold a null or non-finite
    component take no part; where lengths differ, missing components count as zero; an id that occurs again is a
    candidate each time.  Scores are exact while they fit in a long; components too large for that fail with an error.
    Shards of rows meet blocks of queries, and each meeting yields k rows a query.
    """
    spark = vectors.sparkSession
    ready = hold(usable(vectors, scale), "vectors")
    n, n_queries, dims, peak = ready.agg(
        F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v")),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, peak = max(dims or 0, 1), float(peak or 0)
    if dims * peak ** 2 >= 2.0 ** 63:
        raise OverflowError("scores of these vectors do not fit in a long")
    kind = "float64" if dims * peak ** 2 < EXACT else "int64"
    shards, blocks = -(-n // max(64, SHARD_VALUES // dims)), -(-n_queries // BLOCK_QUERIES)

    def matrix(col: pd.Series) -> np.ndarray:
        out = np.zeros((len(col), dims), dtype=kind)
        for i, v in enumerate(col):
            out[i, :len(v)] = v
        return out

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, "int64"),) * 3]
        if len(rows) and len(queries):
            m, ids = matrix(rows["v"]), rows["vec_id"].to_numpy()
            low, high = m.min(axis=0), m.max(axis=0)
            bars = queries["bar"].to_numpy("float64", na_value=-np.inf)
            for q, vector, bar in zip(queries["vec_id"].tolist(), matrix(queries["v"]), bars, strict=True):
                at, score = best_of_shard(vector, m, low, high, ids, q, k, bar)
                found.append((np.full(len(at), q), ids[at], score.astype("int64")))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    place = F.xxhash64("vec_id")
    left = ready.select("*", F.pmod(place, F.lit(shards)).alias("shard"))
    asked = ready.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("*", F.pmod(place, F.lit(blocks)).alias("block"))

    def met(rows: DataFrame, queries: DataFrame) -> DataFrame:
        by, queries = ["shard", "block"], queries.toDF(*queries.columns)  # both sides come from one table
        return rows.select("*", _each(blocks, "block")).groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(meet, FOUND)

    first = hold(met(left.filter("shard = 0"), asked.select("*", F.lit(0).cast("long").alias("shard"), F.lit(None).cast("double").alias("bar"))), "search-first")
    # Where a double may have rounded a score up, the bar is a little lower: no row that reaches it is left out.
    bar = F.when(F.count("*") == k, F.min("score").cast("double") - (0 if kind == "float64" else 4096))
    bars = first.groupBy("query_id").agg(bar.alias("bar"))
    known = asked.join(bars, asked["vec_id"] == bars["query_id"], "left").drop("query_id")
    rest = met(left.filter("shard > 0"), known.select("*", _each(shards, "shard")).filter("shard > 0"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return first.union(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
