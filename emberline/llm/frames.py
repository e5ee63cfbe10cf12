"""Token ids on disk: patched frame-of-reference blocks in segments.

A segment is one byte string of whole documents, all numbers little-endian:

=============  =========================================================================
header         ``PFR1``, documents, tokens, blocks, exceptions (4 x uint32)
documents      id int64, null flag uint8, tokens uint32 for each
block index    byte at which each block's packed bits start, and where the last ends (uint32)
block heads    minimum uint32, bit width uint8, exceptions before it (uint32)
packed bits    128 values less the block's minimum, ``width`` low bits each, lowest first
exceptions     place in the block uint8, true difference uint32: values wider than the block's width
=============  =========================================================================

The width of a block is the given percentile of its values' bit lengths, so a few large ids do not widen it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.batches import filled_ids
from emberline.llm.tokens import encoded, tokenizer_path
from emberline.session import scratch_path

BLOCK = 128
PERCENTILE = 90
#: A segment is closed once it holds so many tokens.
SEGMENT_TOKENS = 1 << 19
END_ID = 1
MAGIC = b"PFR1"


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits each value needs, 0 for 0."""
    return np.frexp(x.astype("float64"))[1].astype("uint8")


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One segment of whole documents."""
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, dtype="uint32")
    grid[:len(ids)] = ids
    grid[len(ids):] = ids[-1] if len(ids) else 0
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, "uint32")
    diff = grid - low[:, None]
    bits = _bit_lengths(diff)
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, at, axis=1)[:, at] if n_blocks else np.zeros(0, "uint8")
    starts = np.concatenate([[0], np.cumsum(width.astype("int64") * (BLOCK // 8))])
    body = np.zeros(starts[-1], dtype="uint8")
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        for some in np.array_split(own, max(1, len(own) // 512)):
            ones = (diff[some][:, :, None] >> np.arange(w, dtype="uint32")) & 1
            packed = np.packbits(ones.astype("uint8").reshape(len(some), -1), axis=1, bitorder="little")
            body[starts[some][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(bits > width[:, None])
    before = np.searchsorted(block, np.arange(n_blocks))
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), n_blocks, len(block)], "<u4").tobytes(),
        doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u4").tobytes(),
        starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), before.astype("<u4").tobytes(),
        body.tobytes(), place.astype("u1").tobytes(), diff[block, place].astype("<u4").tobytes()])


class Segment:
    """Reads a segment: the document table at once, blocks on demand."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.raw, self.at = raw, 4
        docs, self.n_tokens, self.n_blocks, n_exc = self._take("<u4", 4).astype(int)
        self.doc_ids = self._take("<i8", docs)
        self.nulls = self._take("u1", docs).astype(bool)
        self.lengths = self._take("<u4", docs).astype("int64")
        self.starts = self._take("<u4", self.n_blocks + 1).astype("int64")
        self.low = self._take("<u4", self.n_blocks)
        self.width = self._take("u1", self.n_blocks)
        self.before = np.append(self._take("<u4", self.n_blocks), n_exc).astype("int64")
        self.body = self._take("u1", self.starts[-1])
        self.place = self._take("u1", n_exc)
        self.value = self._take("<u4", n_exc)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` to ``last - 1``, padding included."""
        out = np.zeros((last - first, BLOCK), dtype="uint32")
        width = self.width[first:last]
        for w in np.unique(width[width > 0]):
            own = np.flatnonzero(width == w)
            for some in np.array_split(own, max(1, len(own) // 512)):
                packed = self.body[self.starts[first + some][:, None] + np.arange(int(w) * BLOCK // 8)]
                ones = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
                out[some] = ones @ (np.uint32(1) << np.arange(w, dtype="uint32"))
        exc = slice(self.before[first], self.before[last])
        block = np.repeat(np.arange(last - first), np.diff(self.before[first:last + 1]))
        out[block, self.place[exc]] = self.value[exc]
        return (out + self.low[first:last, None]).ravel()

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop - 1`` of the segment; only the blocks they lie in are unpacked."""
        stop = self.n_tokens if stop is None else stop
        if stop <= start:
            return np.zeros(0, "uint32")
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK:stop - first * BLOCK]


SEGMENTS = "part int, seq int, first_doc long, start long, n_docs long, n_tokens long, payload binary"


def segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, percentile: int = PERCENTILE) -> DataFrame:
    """Token segments of all documents in ascending doc_id order (nulls first, equal ids by text).

    One shuffle by ranges of doc_id; a task then tokenises its sorted documents and closes a segment whenever enough
    tokens are together.  ``start`` counts the tokens of the task's earlier segments.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, held, tokens = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids, docs_, nulls, lens = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [part, seq, int(docs_[0]), start, len(docs_), len(ids), pack(ids, docs_, nulls, lens, percentile)]
            names = ["part", "seq", "first_doc", "start", "n_docs", "n_tokens", "payload"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for docs_, ids, offsets in encoded(batches, tokenizer, end_id):
            keys, nulls = filled_ids(docs_), docs_.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(SEGMENT_TOKENS, offsets[-1], SEGMENT_TOKENS)), len(keys)))
            for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                if a < b:
                    held.append((ids[offsets[a]:offsets[b]], keys[a:b], nulls[a:b], np.diff(offsets[a:b + 1])))
                    tokens += offsets[b] - offsets[a]
                if tokens >= SEGMENT_TOKENS:
                    yield close()
                    start, seq, held, tokens = start + int(tokens), seq + 1, [], 0
        if held:
            yield close()

    key = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(key).sortWithinPartitions(key, "text")
    return ordered.mapInArrow(write, SEGMENTS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the segments of all documents as files below ``path``, through Spark's commit."""
    segments(docs, tokenizer, end_id).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document below ``path``, in no order."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: pa.array(ids.view("int32"), pa.int32()), pa.list_(pa.int32()))


def _read(spark, path: str, schema: str, digest, kind: pa.DataType) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                seg = Segment(raw.as_buffer().to_pybytes())
                ends = np.cumsum(seg.lengths)
                starts = ends - seg.lengths
                ids = seg.tokens()
                yield pa.RecordBatch.from_arrays([
                    pa.array(seg.doc_ids, pa.int64(), mask=seg.nulls), pa.array(base + starts), pa.array(seg.lengths),
                    pa.array([digest(ids[a:b]) for a, b in zip(starts, ends, strict=True)], kind)], names)

    stored = spark.read.schema(SEGMENTS).parquet(path)
    # One row for each writing task, so the running total below is over as few rows as there were tasks.
    tasks = stored.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    ahead = F.sum("held").over(Window.orderBy("part")) - F.col("held")
    based = stored.join(F.broadcast(tasks.select("part", ahead.alias("ahead"))), "part")
    return based.select((F.col("ahead") + F.col("start")).alias("base"), "payload").mapInArrow(unpack, schema)


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids as files in the shared folder and describe them from what is read back.

    doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32.  A null or empty text has
    the end id alone.  Repeated ids and texts each keep their row; a null doc_id comes first.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path(), end_id)
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long",
                 lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())
