"""Near-duplicate vectors by int8 tile products with error bounds for each vector.

Equal vectors are one class, which is compared once.  Classes meet in tiles: both sides are quantised to signed bytes and
multiplied as whole numbers.  A vector's quantisation error, measured in full precision, bounds how far a product can be
from the cosine, whatever the other vector is: what stays below the threshold by more than that is out, what
exceeds it by more than that is linked, and only what lies between is computed from the vectors themselves.

All classes meet, in one bucket, unless a call asks for less.  Then sign tables decide: each table cuts space by some
hyperplanes, and classes on the same side of all share a bucket.  A pair at the threshold angle shares a bucket of some
table with probability ``recall``, a closer one with more; the number of cuts and tables follows from the number of classes
by cost.  A bucket of more rows than a tile is dealt into parts of some tiles, each of which meets each other, so no task
holds more than two parts; pairs of parts are dealt into passes, as each part is copied to all others.  A pair counts in
the first table where it meets.  Parts yield a row a vector and star: its links there and the star it belongs to.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.repeats import release
from emberline.operators.components import min_label
from emberline.session import hold

THRESHOLD = 0.9
#: Share of the pairs right at the threshold that meet, nearer pairs more often; with 1 all pairs meet.
RECALL = 1.0
#: Rows of a tile at most, and values of a tile where vectors are long.
TILE_ROWS, TILE_VALUES = 4096, 1 << 22
#: Parts of a bucket that are as small as a tile, and tiles of a part where there are more.
PARTS, TILES = 12, 8
#: Bytes that a pass moves in any case, and what a row has besides its vector.
LEAST_MOVED, ROW_BYTES = 1 << 28, 64
#: Left rows of one product.
BLOCK_ROWS = 512
#: Seconds for a component of a product, for looking at a product, and for moving a component of a vector.
MULTIPLY, LOOK, MOVE = 3e-11, 1e-9, 1.5e-7
#: Members of a whole-number product that single precision adds exactly: 127 * 127 * 1024 is below 2 ** 24.
EXACT = 1024
#: Most that single precision rounds a value of at most one by; a matrix with a smaller share of entries is looked at entry by entry.
ROUNDING, SPARSE = 2.0 ** -23, 16
#: What rounding in double precision can add to a cosine, beyond what errors are measured to.
SLACK = 1e-9
SEED = 20_241


def tile_rows(dims: int) -> int:
    return max(64, min(TILE_ROWS, TILE_VALUES // max(dims, 1)))


def part_rows(dims: int) -> int:
    return max(tile_rows(dims), min(TILES * tile_rows(dims), TILE_VALUES // max(dims, 1)))


def tables_for(n: int, dims: int, threshold: float, recall: float) -> tuple[int, int]:
    """Cuts of a table and number of tables of least cost; 0 cuts and 1 table let all meet."""
    if recall >= 1 or threshold <= 0:
        return 0, 1
    # Bytes turn a vector by a little; half a degree is more than that.
    same = 1 - (math.acos(min(1.0, threshold)) + 0.01) / math.pi
    best, tile = None, tile_rows(dims)
    for cuts in range(0, 41):
        tables = 1 if not cuts else math.ceil(math.log(1 - recall) / math.log(1 - same ** cuts))
        bucket = n / 2 ** cuts
        cost = tables * (bucket / 2 * (dims * MULTIPLY + LOOK) + math.ceil(bucket / tile) * dims * MOVE)
        if best is None or cost < best[0]:
            best = (cost, cuts, tables)
    return best[1], best[2]


def planes(cuts: int, tables: int, dims: int) -> np.ndarray:
    """Whole-number normals of all tables' hyperplanes: with bytes, their products are exact."""
    return np.rint(np.random.default_rng(SEED).normal(0, 64, (tables * cuts, dims)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact: squares then neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def quantised(x: np.ndarray) -> np.ndarray:
    """Whole numbers -127 to 127 in proportion to each scaled row, by its largest component."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True)))


def buckets(codes: np.ndarray, normals: np.ndarray, cuts: int, tables: int) -> np.ndarray:
    """Bucket of each row in each table."""
    if not cuts:
        return np.zeros((len(codes), tables), "int64")
    side = (codes @ normals.T >= 0).reshape(len(codes), tables, cuts)
    return side @ (1 << np.arange(cuts, dtype="int64"))


class Side:
    """One tile: vectors, their norms, bytes, scales and error bounds."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = scaled(x)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.codes = quantised(self.x)
        self.scale = np.abs(self.x).max(axis=1) / 127 / self.norm
        close = self.codes * self.scale[:, None]
        self.close = np.sqrt(np.einsum("ij,ij->i", close, close))
        gap = self.x / self.norm[:, None] - close
        self.error = np.sqrt(np.einsum("ij,ij->i", gap, gap)) + 1e-12
        self.bytes = self.codes.astype("float32")


def links(left: Side, right: Side, threshold: float) -> np.ndarray:
    """Which rows of two tiles have a cosine of at least the threshold.

    One comparison with each row's widest bound leaves what may link; only that is looked at with the bound of its pair, entry
    by entry where it is sparse and the whole block at once where it is not.
    """
    out = np.zeros((len(left.x), len(right.x)), dtype=bool)
    dims = left.x.shape[1]
    # Single precision rounds each sum of a piece and each scaling once more: that much is added to the bounds.
    slack = SLACK + ROUNDING * (4 + dims / EXACT)
    widest, worst = (right.close + right.error).max(initial=0), right.error.max(initial=0)
    for a in range(0, len(out), BLOCK_ROWS):
        own = slice(a, a + BLOCK_ROWS)
        product = left.bytes[own, :EXACT] @ right.bytes[:, :EXACT].T
        for d in range(EXACT, dims, EXACT):
            product += left.bytes[own, d:d + EXACT] @ right.bytes[:, d:d + EXACT].T
        product *= right.scale[None, :].astype("float32")
        product *= left.scale[own, None].astype("float32")
        low = threshold - slack - left.error[own] * widest - left.close[own] * worst
        may = product >= np.nextafter(low.astype("float32"), np.float32(-np.inf))[:, None]
        n = np.count_nonzero(may)
        if not n:
            continue
        # (c + e)(c' + e') - cc' for the two vectors' bytes c, c' and errors e, e', by their lengths.
        if n * SPARSE <= may.size:
            i, j = np.divmod(np.flatnonzero(may), may.shape[1])
            bound = left.error[own][i] * (right.close + right.error)[j] + left.close[own][i] * right.error[j] + slack
            over = product[i, j].astype("float64") - threshold
            sure = over >= bound
            out[i[sure] + a, j[sure]] = True
            between = (over >= -bound) & ~sure
            i, j = i[between], j[between]
        else:
            bound = left.error[own, None] * (right.close + right.error)[None, :] + left.close[own, None] * right.error[None, :] + slack
            over = product.astype("float64") - threshold
            sure = over >= bound
            out[own] = sure
            i, j = np.nonzero((over >= -bound) & ~sure)
        step = max(1, TILE_VALUES // dims)
        for k in range(0, len(i), step):
            p, q = i[k:k + step] + a, j[k:k + step]
            out[p, q] = np.einsum("ij,ij->i", left.x[p], right.x[q]) / (left.norm[p] * right.norm[q]) >= threshold
    return out


def only_first(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Clear the links of pairs that share a bucket of an earlier table; the sides' buckets have a column for each of those."""
    if np.count_nonzero(found) * SPARSE <= found.size:
        i, j = np.divmod(np.flatnonzero(found), found.shape[1])
        met = (left[i] == right[j]).any(axis=1)
        found[i[met], j[met]] = False
        return
    for u in range(left.shape[1]):
        found &= left[:, u, None] != right[None, :, u]


def stars(met: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links a node of its component, or -1 without links."""
    to_left, to_right = np.full(len(left), -1, "int64"), np.full(len(right), -1, "int64")
    for i in np.flatnonzero(met.any(axis=1)).tolist():
        if to_left[i] >= 0:
            continue
        to_left[i] = left[i]
        rows = np.array([i])
        while len(rows):
            columns = np.flatnonzero(met[rows].any(axis=0) & (to_right < 0))
            to_right[columns] = left[i]
            rows = np.flatnonzero(met[:, columns].any(axis=1) & (to_left < 0))
            to_left[rows] = left[i]
    return to_left, to_right


def _stored(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, digest, v of every row: the vector's bytes and their hash, null where it can link with nothing."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            ends, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            values = lists.values.to_numpy(zero_copy_only=False).astype(dtype) + 0  # a null is NaN; no negative zero
            sound, full = np.concatenate([[0], np.cumsum(~np.isfinite(values))]), np.concatenate([[0], np.cumsum(values != 0)])
            ok = valid & (sound[ends[1:]] == sound[ends[:-1]]) & (full[ends[1:]] > full[ends[:-1]])
            # Zeros at the end are no difference, as missing components count as zero.
            raw = [np.trim_zeros(values[a:b], "b").tobytes() if good else None for a, b, good in zip(ends[:-1], ends[1:], ok.tolist(), strict=True)]
            digest = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "v"])

    e = F.col("embedding").cast("array<float>" if single else "array<double>").alias("e")
    return vectors.select(F.col("vec_id").cast("long"), e).mapInArrow(run, "vec_id long, digest binary, v binary"), dtype


def _matrix(raw: list[bytes], dtype: str, dims: int) -> np.ndarray:
    out = np.zeros((len(raw), dims))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, dtype)
        out[i, :len(v)] = v
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (``vec_id``, ``embedding``).

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold``, which is above 0; each
    pair of different vectors at the threshold is met with probability ``recall``, and all of them unless that is below 1.  ``n_links``
    counts linked rows, copies each; ``component_id`` is the least vec_id reachable.  A vector that is null, empty or zero or
    holds a null or non-finite component links with nothing.  Where lengths differ, missing components are zero.  A
    null vec_id names no component unless it has no other; repeated ids keep a row each.  ``kept`` is vec_id =
    component_id, true for a null id in a component without one.  Other columns play no part.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    stored, dtype = _stored(vectors)
    rows = hold(stored, "vector-rows")
    classes = hold(rows.filter("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    n, width = classes.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    none = rows.filter("digest is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return none
    dims = width // np.dtype(dtype).itemsize
    cuts, tables = tables_for(n, dims, threshold, recall)
    normals, tile = planes(cuts, tables, dims), tile_rows(dims)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, tile):
                part = batch.slice(a, tile)
                own = buckets(quantised(scaled(_matrix(part.column("v").to_pylist(), dtype, dims))), normals, cuts, tables)
                ends = pa.array(np.arange(0, own.size + 1, tables, dtype="int32"))
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], ["c", "bucket"])

    placed = classes.select("c", "v").mapInArrow(sign, "c long, bucket array<long>").select("c", F.posexplode("bucket").alias("t", "bucket"))
    keys = hold(placed, "vector-keys")
    parts = F.greatest(F.least(F.ceil(F.count("*") / tile), F.lit(PARTS).cast("long")), F.ceil(F.count("*") / part_rows(dims)))
    full = hold(keys.groupBy("t", "bucket").agg(parts.alias("parts"), F.count("*").alias("size")).filter("size > 1"), "vector-buckets")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(
        F.least("own", j).alias("x"), F.greatest("own", j).alias("y"), (j < F.col("own")).alias("second")))
    moved = (full.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] or 0) * (width + ROW_BYTES)
    passes = max(1, -(-moved // max(LEAST_MOVED, n * width)))

    def compare(key: tuple[int, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        t, _, x, y = key
        second = pdf["second"].to_numpy(bool)
        halves = [pdf[~second], pdf[second]] if x != y else [pdf]
        tiles = [[(p["c"].to_numpy("int64"), p["m"].to_numpy("int64"), Side(_matrix(p["v"].tolist(), dtype, dims)))
                  for p in (half[a:a + tile] for a in range(0, len(half), tile))] for half in halves]
        out = [pd.DataFrame({"c": [], "star": [], "n": []}, dtype="int64")]
        for i, (ids, times, left) in enumerate(tiles[0]):
            for j, (others, many, right) in enumerate(tiles[-1]):
                if x == y and j < i:
                    continue
                same = x == y and i == j
                found = links(left, right, threshold)
                if same:
                    np.fill_diagonal(found, False)
                if t and found.any():
                    only_first(found, *[buckets(s.codes, normals[:t * cuts], cuts, int(t)) for s in (left, right)])
                if not found.any():
                    continue
                linked, columns = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
                found, own, other = found[np.ix_(linked, columns)], ids[linked], others[columns]
                # Within one tile a row and its column are the same vector: the column's star joins the row's, its links count once.
                counts = [found @ many[columns], times[linked] @ found if not same else np.zeros(len(columns), "int64")]
                out += [pd.DataFrame({"c": c, "star": r, "n": k}) for c, r, k in zip((own, other), stars(found, own, other), counts, strict=True)]
        return pd.concat(out).groupby(["c", "star"], as_index=False)["n"].sum()

    links_found = []
    for i in range(passes):
        placed = keys.join(full, ["t", "bucket"]).join(classes.select("c", "m", "v"), "c").withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")))
        met = placed.select("t", "bucket", "c", "m", "v", F.inline(every)).filter(F.pmod(F.xxhash64("t", "bucket", "x", "y"), F.lit(passes)) == i)
        links_found.append(hold(met.groupBy("t", "bucket", "x", "y").applyInPandas(compare, "c long, star long, n long"), "vector-links"))
        del placed, met
        if passes > 1:
            release(vectors.sparkSession)
    found = reduce(DataFrame.union, links_found)
    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = min_label(found.filter("c <> star").select(F.col("c").alias("a"), F.col("star").alias("b")))
    named = hold(classes.select("digest", "least", "m", "c").join(roots, F.col("c") == F.col("node"), "left").withColumn(
        "root", F.coalesce("label", "c")).drop("node", "label"), "vector-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = hold(named.join(least, "root").join(counts, "c", "left").select(
        "digest", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "vector-facts")
    # A class may hold a third of all rows: both sides are plain tables here, so that the join can be split.
    linked = rows.filter("digest is not null").select("vec_id", "digest").join(facts, "digest").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.union(none)


NEAR_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
