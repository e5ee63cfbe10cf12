"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks of equal size are the seats: sources win them by the highest quotients of their targets.  What a source has won is
cut into larger blocks where it is much, again of equal size, and the shards of the source win these by the highest
quotients of their sizes.  Within a shard documents stand in seeded order, and a seeded choice says which blocks are taken
once more.  A document takes the words of its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.batches import slices
from emberline.session import hold

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
SEED = 20240607
#: Largest block of a source, and the blocks that a smaller source's target is cut into; sources are dealt the smallest.
BLOCK_WORDS, TARGET_BLOCKS = 4096, 1000
#: Documents of a source that share a shard, about.
SHARD_DOCS = 512


def words(text: Column) -> Column:
    """Number of words between runs of U+0020 and U+0009 to U+000D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def highest_quotients(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Lague: ``seats`` go one by one to the highest votes / (2 held + 1), never beyond ``most``.

    Ties go to the earlier party.  A divisor close to the last winning quotient gives nearly all seats at once; the
    few that are left or too many are settled by quotients.
    """
    votes = np.asarray(votes, dtype="float64")
    most = np.where(votes > 0, most, 0).astype("int64")
    seats = int(min(seats, most.sum()))
    if not seats:
        return np.zeros(len(votes), dtype="int64")

    def held(quotient: float) -> np.ndarray:
        """Seats whose quotient votes / (2k + 1) is above the given one."""
        return np.minimum(np.maximum(np.ceil((votes / quotient - 1) / 2), 0), most).astype("int64")

    lo, hi = votes[votes > 0].min() / (2.0 * seats + 3), votes.max() * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if held(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    won = held(hi)
    for _ in range(seats - int(won.sum())):
        quotient = np.where(won < most, votes / (2 * won + 1), -1.0)
        won[int(quotient.argmax())] += 1
    return won


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: np.ndarray) -> np.ndarray:
    """Shares of ``total`` by weight; what exceeds a cap is shared again by weight until nothing does."""
    out = np.zeros(len(sizes))
    fixed = np.zeros(len(sizes), dtype=bool)
    while not fixed.all():
        free = ~fixed
        share = (total - out[fixed].sum()) * weights[free] / weights[free].sum()
        over = share > cap[free]
        at = np.flatnonzero(free)
        if not over.any():
            out[at] = share
            break
        out[at[over]] = cap[at[over]]
        fixed[at[over]] = True
    return out


def rank_weights(names: list[str | None]) -> np.ndarray:
    """Weights 1, 2, 3, repeating, for sources in code point order, null last."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    out = np.zeros(len(names))
    out[order] = np.arange(len(names)) % 3 + 1
    return out


def mixed(
    docs: DataFrame,
    weigh: Callable[[list[str | None]], np.ndarray] = rank_weights,
    share: float = 1.0,
    seed: int = SEED,
    key: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (in words), and the runs of words taken.

    ``runs`` lists (first word, words, times).  No document gives more than three times its words.  A null source is
    a source of its own; null and empty texts have size 0 and give nothing; repeated rows count each.  Runs again
    alike: order and choice depend on the seed, doc_id and text.  Where more than ``SHARD_DOCS`` rows agree in both, each
    is drawn by a number, as read, so that they do not meet in one shard.  A long column ``key`` that tells rows apart is
    carried along and serves as that number.  The table of sources, a row for each, is planned on the driver; sizes
    stay on the executors.
    """
    row, own = key or "_row", [key] if key else []
    spark = docs.sparkSession
    number = F.col(key) if key else F.monotonically_increasing_id()
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("text", F.lit("")), F.lit(seed))
    sized = hold(docs.select(F.col("doc_id").cast("long"), "source", words(F.col("text")).alias("size"), draw.alias("draw"), number.alias(row)), "mix-sizes")
    crowds = hold(sized.groupBy("draw").agg(F.count("*").alias("rows")).filter(F.col("rows") > SHARD_DOCS), "mix-crowds")
    sized = sized.join(crowds, "draw", "left").withColumn("draw", F.when(F.col("rows").isNotNull(), F.xxhash64("draw", row)).otherwise(F.col("draw")))
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    names = [r["source"] for r in table]
    sizes = np.array([r["source_size"] for r in table], dtype="float64")
    total = sizes.sum() * share
    target = targets(sizes, weigh(names), total, MAX_REPEATS * sizes) if len(table) else sizes
    block = np.clip(target // TARGET_BLOCKS, 1, BLOCK_WORDS)
    least = block[target > 0].min(initial=BLOCK_WORDS)
    by_name = np.array([i for i, _ in sorted(enumerate(names), key=lambda x: (x[1] is None, x[1] or ""))], dtype="int64")
    seats = np.zeros(len(names), dtype="int64")
    seats[by_name] = highest_quotients(target[by_name], round(total / least), np.floor(MAX_REPEATS * sizes[by_name] / least))
    seats = np.round(seats * least / block)
    plan = spark.createDataFrame(
        [(n, int(s), float(t), int(q), float(b), max(1, -(-r["n"] // SHARD_DOCS)))
         for n, s, t, q, b, r in zip(names, sizes, target, seats, block, table, strict=True)],
        "source string, source_size long, target double, seats long, block double, n_shards long")
    placed = hold(sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", sized["source"].alias("source"), "size", "source_size", "target", "seats", "block",
        F.pmod("draw", "n_shards").alias("shard"), F.shiftrightunsigned("draw", 8).alias("draw"), row), "mix-placed")

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        n = np.maximum(np.round(pdf["held"].to_numpy() / pdf["block"].iloc[0]), pdf["held"].to_numpy() > 0).astype("int64")
        pdf["quota"] = highest_quotients(pdf["held"].to_numpy(), int(pdf["seats"].iloc[0]), MAX_REPEATS * n)
        pdf["n_blocks"] = n
        return pdf[["source", "shard", "n_blocks", "quota"]]

    quotas = placed.groupBy("source", "seats", "block", "shard").agg(F.sum("size").alias("held")).groupBy("source").applyInPandas(
        apportion, "source string, shard long, n_blocks long, quota long").withColumnsRenamed({"source": "s", "shard": "k"})
    ready = placed.join(quotas, placed["source"].eqNullSafe(quotas["s"]) & (placed["shard"] == quotas["k"])).drop("s", "k")

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "doc_id", "size", row], ignore_index=True)
        size = pdf["size"].to_numpy()
        n, quota, shard = int(pdf["n_blocks"].iloc[0]), int(pdf["quota"].iloc[0]), int(pdf["shard"].iloc[0])
        ends = np.cumsum(size)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in size]
        taken = np.zeros(len(size), dtype="int64")
        if n:
            times = np.full(n, quota // n, dtype="int64")
            times[np.random.default_rng([seed, shard]).permutation(n)[:quota % n]] += 1
            cuts = np.arange(n + 1) * int(ends[-1]) // n
            new = np.flatnonzero(np.diff(times, prepend=times[0] - 1))  # equal neighbours are one run
            edges = np.unique(np.concatenate([cuts[new], ends, [0]]))
            a, b = edges[:-1], edges[1:]
            k = times[np.searchsorted(cuts, a, side="right") - 1]
            doc = np.searchsorted(ends, a, side="right")
            np.add.at(taken, doc, (b - a) * k)
            first = a - (ends - size)[doc]
            for d, f, w, t in zip(doc.tolist(), first.tolist(), (b - a).tolist(), k.tolist(), strict=True):
                if t:
                    runs[d].append((f, w, t))
        pdf["taken"], pdf["runs"] = taken, runs
        return pdf[["doc_id", "source", "size", "source_size", "target", "taken", "runs", *own]]

    return ready.groupBy("source", "shard").applyInPandas(
        select, "doc_id long, source string, size long, source_size long, target double, taken long, "
                "runs array<struct<first:long, n:long, times:long>>" + "".join(f", {c} long" for c in own))


_WORD = re.compile(WORD)


def layers(text: str, runs: list[tuple[int, int, int]]) -> list[str]:
    """The texts that runs of words (first, number, times) ask for: whole and partial copies, one a layer."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out = []
    for layer in range(max((t for _, _, t in runs), default=0)):
        pieces: list[list[int]] = []
        for first, n, times in sorted(runs):
            last = min(first + n, len(spans))
            if times > layer and first < last:
                if pieces and pieces[-1][1] == first:
                    pieces[-1][1] = last
                else:
                    pieces.append([first, last])
        if pieces:
            whole = len(pieces) == 1 and pieces[0] == [0, len(spans)]
            out.append(text if whole else "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in pieces))
    return out


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents (doc_id, text, lang, source, n_chars): a row for each whole or partial copy taken.

    Partial copies keep the words and the white space of their runs.  Rows are written with a number each, by which
    every row gets its own runs, whatever ids it shares or lacks.
    """
    rows = hold(docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"),
                            F.monotonically_increasing_id().alias("_row")), "mix-rows")
    runs = mixed(rows, key="_row").filter("taken > 0").select("_row", F.col("runs").alias("_runs"))
    ready = rows.join(runs, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [layers(t or "", [(r["first"], r["n"], r["times"]) for r in rs]) for t, rs in zip(
                    part.column("text").to_pylist(), part.column("_runs").to_pylist(), strict=True)]
                at = pa.array([i for i, ts in enumerate(got) for _ in ts], pa.int64())
                texts = [t for ts in got for t in ts]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(at), pa.array(texts, pa.string()), part.column("lang").take(at),
                    part.column("source").take(at), pa.array([len(t) for t in texts], pa.int64())],
                    ["doc_id", "text", "lang", "source", "n_chars"])

    return ready.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
