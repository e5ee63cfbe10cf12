"""Order-preserving packing of documents into training windows.

A window takes a run of the token stream.  Where to cut is a shortest path over candidate cuts: document ends,
sentence ends and, in runs without either, every few hundred tokens.  A window costs its padding plus a charge for
starting at all, a cut inside a document costs a truncation penalty.  For windows that must be padded to the full
length the cost of (i, j) is f(i) + pos(i) plus what depends on j alone, so the best i in reach is the front of a
monotone queue; windows of exactly a power of two need no padding and are looked up beside it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import encoded, shared_tokenizer, tokenizer_path

WINDOW = 4096
END_ID = 2
#: Costs in padded tokens: opening a window, a cut at a sentence end, a cut anywhere else.
OPEN_COST, SENTENCE_COST, HARD_COST = 64, 16, 128
#: Longest run without a candidate cut.
MAX_GAP = 256
#: Tokens planned together; only the last window of a plan is planned again with what follows.
PLAN_TOKENS = 128 * WINDOW
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions, 0 and ``n`` among them, and the penalty of each."""
    soft = np.unique(np.concatenate([[0, n], doc_ends, sentence_ends]))
    gaps = np.diff(soft)
    extra = [np.arange(soft[i] + MAX_GAP, soft[i + 1], MAX_GAP) for i in np.flatnonzero(gaps > MAX_GAP)]
    pos = np.unique(np.concatenate([soft, *extra])).astype("int64")
    cost = np.full(len(pos), HARD_COST, dtype="int64")
    cost[np.searchsorted(pos, sentence_ends)] = SENTENCE_COST
    cost[np.searchsorted(pos, doc_ends)] = 0
    cost[0] = cost[-1] = 0
    return pos, cost


def best_cuts(pos: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``pos`` of the cheapest chain of cuts from the first to the last position."""
    exact: dict[int, list[int]] = {}
    k = 1
    while k <= window:
        i = np.searchsorted(pos, pos - k)
        for j in np.flatnonzero((pos >= k) & (pos[np.minimum(i, len(pos) - 1)] == pos - k)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        k *= 2
    at, pen = pos.tolist(), cost.tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # (f(i) + pos(i), i), ascending
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - window:
            queue.popleft()
        value, i = queue[0]
        value += window - p
        for e in exact.get(j, ()):
            if best[e] < value:
                value, i = best[e], e
        best[j] = value = value + OPEN_COST + pen[j]
        back[j] = i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chain = [len(at) - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


class _Stream:
    """The tokens of one task that are not yet in a window, and the documents they belong to."""

    def __init__(self, task: int, sentence_ids: np.ndarray, window: int):
        self.next_id, self.sentence_ids, self.window = task << 40, sentence_ids, window
        self.ids = np.zeros(0, "uint32")
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens in all, tokens already placed

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [(d, n, 0) for d, n in zip(doc_ids, np.diff(offsets).tolist(), strict=True)]

    def place(self, last: bool) -> pa.RecordBatch:
        """Plan what is there; all windows but the last are final, or all if nothing follows."""
        left = np.array([n - done for _, n, done in self.docs], dtype="int64")
        ends = np.cumsum(left)
        sentence = np.flatnonzero(np.isin(self.ids, self.sentence_ids)) + 1
        pos, cost = candidates(len(self.ids), ends, sentence)
        cuts = pos[best_cuts(pos, cost, self.window)]
        if not last:
            cuts = cuts[:-1]
        stop = int(cuts[-1])
        edges = np.unique(np.concatenate([cuts, ends[ends < stop]]))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, a, side="right")
        win = np.searchsorted(cuts, a, side="right") - 1
        ahead = ends[doc] - left[doc]
        done = np.array([x[2] for x in self.docs], dtype="int64")
        raw = self.ids.astype("<u4").tobytes()
        out = pa.RecordBatch.from_arrays([
            pa.array([self.docs[i][0] for i in doc], pa.int64()), pa.array(a - ahead + done[doc]), pa.array(b - a),
            pa.array([zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
            pa.array([self.docs[i][1] for i in doc], pa.int64()), pa.array(self.next_id + win), pa.array(a - cuts[win])],
            [c.split()[0] for c in PIECES.split(", ")])
        self.next_id += len(cuts) - 1
        first = int(np.searchsorted(ends, stop, side="right"))
        rest = self.docs[first:]
        if rest:
            d, n, was = rest[0]
            rest[0] = (d, n, was + max(0, stop - int(ends[first] - left[first])))
        self.docs, self.ids = rest, self.ids[stop:]
        return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` tokens, in ascending doc_id order.

    doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens, sequence_id, offset.  Every
    id lies in one piece; pieces of a sequence follow each other without a gap.  A null or empty text is its end id
    alone; a null doc_id comes first; repeated rows are packed one by one; an empty table gives no rows.  Documents
    are dealt by ranges of doc_id, and each task plans its own stream, a bounded stretch at a time.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [shared_tokenizer(path).tool.encode(m, add_special_tokens=False).ids for m in (".", "!", "?")]
        stream = _Stream(TaskContext.get().partitionId(), np.array([m[0] for m in marks], "uint32"), window)
        for part, ids, offsets in encoded(batches, path, end_id):
            keys = part.column("doc_id").to_pylist()
            cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(PLAN_TOKENS, offsets[-1], PLAN_TOKENS)), len(keys)))
            for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                if a < b:
                    stream.add(keys[a:b], ids[offsets[a]:offsets[b]], offsets[a:b + 1])
                if len(stream.ids) >= PLAN_TOKENS:
                    yield stream.place(last=False)
        if len(stream.ids):
            yield stream.place(last=True)

    key = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(key).sortWithinPartitions(key, "text")
    return ordered.mapInArrow(run, PIECES)
