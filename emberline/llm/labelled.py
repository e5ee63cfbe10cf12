"""Shared by the two classifiers: labelled rows, folds, bounded samples and logistic calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id falls in none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, y (0.0 or 1.0), draw (a hash) of labelled documents outside the held-out fold; y is the larger of several."""
    y = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    return y.filter(fold(folds) != held_out).withColumn("draw", F.xxhash64("doc_id", F.lit(label)))


def first_drawn(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labels, in the order of their draw."""
    return labels.orderBy("draw", "doc_id").limit(most)


def sampled_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text and the columns of a bounded sample of labels; whole texts, null ones empty.

    The sample is limited to a number of rows of two numbers each, so it is broadcast and no text is shuffled.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return known.join(F.broadcast(sample), "doc_id")


def dense_sums(counts: DataFrame, key: str, values: list[str], size: int, block: int = 4096) -> np.ndarray:
    """Sums of some columns by an integer key below ``size``: a dense row for each column.

    They reach the driver as packed blocks and not as a row for each key.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[key].to_numpy()
        out = np.zeros((len(values), block), dtype="<i8")
        out[:, at % block] = pdf[values].to_numpy().T
        return pd.DataFrame({"block": [int(at[0]) // block], "raw": [out.tobytes()]})

    sums = counts.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])
    dense = np.zeros((len(values), -(-size // block) * block), dtype="int64")
    for r in sums.groupBy(F.floor(F.col(key) / block)).applyInPandas(pack, "block long, raw binary").collect():
        dense[:, r["block"] * block:(r["block"] + 1) * block] = np.frombuffer(r["raw"], "<i8").reshape(len(values), block)
    return dense[:, :size]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> dict[str, np.ndarray]:
    """Logistic regression by damped Newton steps on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(np.logaddexp(0, m).sum() - y @ m + (penalty * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = z.T @ (z * np.maximum(p * (1 - p), 1e-9)[:, None]) + np.diag(penalty)
        step = np.linalg.solve(hess, z.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return {"w": w, "mean": mean, "scale": scale}


def probability(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    m = model["w"][0] + ((x - model["mean"]) / model["scale"]) @ model["w"][1:]
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
