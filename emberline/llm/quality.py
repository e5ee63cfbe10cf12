"""Compression classifier of text quality.

One zstandard dictionary is built from good and one from bad labelled text.  A text whose pieces pack smaller with
the good dictionary reads like good text; the difference of the two sizes over the plain size, beside how far the
text packs at all, becomes a calibrated probability by logistic regression on labelled rows the dictionaries have
not seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.batches import slices, worker_cache
from emberline.llm.labelled import first_drawn, fit_logistic, fold, probability, sampled_rows, training_labels
from emberline.session import hold

FOLDS, HELD_OUT = 3, 1
#: Bytes of a text that are packed together; every piece of a text counts.
PIECE = 4096
LEVEL = 3
DICTIONARY_BYTES = 1 << 16
#: Bounds of the labelled sample: documents and pieces of each class for its dictionary, documents for the calibration.
DICTIONARY_DOCS, DICTIONARY_PIECES, CALIBRATION_DOCS = 1500, 3000, 20_000


class Compressors:
    """The plain compressor and those with the bad and the good dictionary."""

    def __init__(self, dictionaries: list[bytes]):
        import zstandard as zstd

        self.tools = [zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)]
        for raw in dictionaries:
            known = zstd.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.tools.append(zstd.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        for i, t in enumerate(texts):
            raw = memoryview(t.as_buffer())
            if len(raw):
                plain, bad, good = (
                    sum(len(tool.compress(raw[k:k + PIECE])) for k in range(0, len(raw), PIECE)) for tool in self.tools)
                out[i] = (bad - good) / plain, plain / len(raw), good / len(raw), np.log(len(raw))
        return expanded(out)


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with their squares and products, for a curved boundary."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, x[:, i] * x[:, j]])


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the bare text where there is too little to train on."""
    import zstandard as zstd

    samples = [s for s in samples if s]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def _measured(rows: DataFrame, dictionaries: list[bytes], model: dict | None, keep: list[str], schema: str) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    shipped = sc.broadcast(dictionaries)  # two dictionaries of DICTIONARY_BYTES each at most
    key = hashlib.sha256(b"".join(dictionaries)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if key not in cache:
            cache[key] = Compressors(shipped.value)
        for batch in batches:
            for part in slices(batch):
                x = cache[key].features(pc.fill_null(part.column("text").cast(pa.string()), ""))
                cols = [part.column(c) for c in keep]
                if model is None:
                    cols.append(pa.array(x.tolist(), pa.list_(pa.float64())))
                else:
                    p = probability(model, x)
                    cols += [pa.array(p), pa.array((p >= 0.5).astype("int32"))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """Dictionaries (bad, good) and the calibration, from bounded samples of labelled rows in the order of their draw."""
    known = hold(training_labels(labels, "quality", FOLDS, HELD_OUT), "quality-labels")
    own = known.filter(F.pmod("draw", F.lit(2)) == 0)
    rows = sampled_rows(docs, first_drawn(own.filter("y = 0"), DICTIONARY_DOCS).union(first_drawn(own.filter("y = 1"), DICTIONARY_DOCS)))
    count = F.greatest(F.ceil(F.length("text") / PIECE).cast("int"), F.lit(1))
    pieces = hold(rows.select("doc_id", "y", F.posexplode(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(
        F.col("text"), (i - 1) * PIECE + 1, F.lit(PIECE)))).alias("n", "piece")), "quality-pieces")
    order = F.xxhash64("doc_id", "n", F.lit("piece"))
    dictionaries = [_dictionary([r["piece"].encode() for r in pieces.filter(F.col("y") == c).orderBy(order, "doc_id", "n").select(
        "piece").limit(DICTIONARY_PIECES).collect()]) for c in (0.0, 1.0)]
    sample = sampled_rows(docs, first_drawn(known.filter(F.pmod("draw", F.lit(2)) == 1), CALIBRATION_DOCS))
    got = _measured(sample, dictionaries, None, ["doc_id", "y"], "doc_id long, y double, x array<double>").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, expanded(np.zeros((1, 4))).shape[1])
    y = np.array([r["y"] for r in got])
    if not len(got):
        x, y = np.zeros((1, x.shape[1])), np.full(1, 0.5)
    return dictionaries, fit_logistic(x, y)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text counts as empty; equal texts have equal scores; without labelled rows every score is 0.5.  A null
    doc_id is held out as false.  Documents stream through once, without a shuffle.
    """
    dictionaries, model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return _measured(rows, dictionaries, model, ["doc_id", "held_out"], "doc_id long, held_out boolean, score double, predicted int")
