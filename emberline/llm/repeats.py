"""Removal of repeated byte strings across a corpus by a depth-limited radix sort of suffixes.

Suffixes matter only through their first THRESHOLD bytes: two that agree so far are an occurrence of a repeated
string.  Most-significant-digit passes find those groups.

1. The digit of the first pass is the suffix's anchor gram.  Runs of neighbouring suffixes share it, so one row stands
   for a run; whoever shares its digit with nobody is sorted and leaves.
2. Inside a gram's bucket, runs with equal contexts are in equal order throughout: all but the first are repeats.  The
   first of each context goes on only on a side whose bytes next to the gram another context of the bucket shares.
3. What is left is taken suffix by suffix, by two digits of half the threshold each.  All but the first of an equal
   group are repeats.

Every task first sorts its own slice and sends one row of each equal group only, and the few grams that a sample
shows to be very frequent are dealt out by context, so that no string however common makes one large group.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.batches import filled_ids, mix, slices
from emberline.llm.suffixes import HALF, SIDE_BITS, STRETCH, THRESHOLD, runs, windows
from emberline.session import hold

#: One document in so many shows which grams are frequent, which many there must hold one, and how many are noted.
SAMPLE_EVERY, FREQUENT, NOTED = 64, 12, 20_000
#: Parts over which a frequent gram is dealt out.
PARTS = 1024
ROW = "key long, context long, doc long, row long, place long"
# Bits of ``place``, from the top: first byte of the run, further windows, anchor offset, side hashes, flags.
_FIRST, _MORE, _ANCHOR, _LEFT, _RIGHT, _WIDE, _DONE = 32, 25, 18, 10, 2, 1, 0


def release(spark: SparkSession) -> None:
    """Let the driver collect what is done with, so that its shuffle files leave the executors' disks.

    Once for the plans that Python has let go of, once for the shuffles that those held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row and each text's offsets; a null text has none."""
    raw = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(raw.buffers()[1], "int32", len(raw) + 1, raw.offset * 4).astype("int64")
    data = np.frombuffer(raw.buffers()[2], "uint8") if raw.buffers()[2] is not None and len(raw.buffers()[2]) else np.zeros(0, "uint8")
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slice_runs(texts: pa.Array) -> dict[str, np.ndarray]:
    """Runs of all documents of a slice, with the document's number; places are within the document."""
    data, offsets = utf8(texts)
    parts: list[dict[str, np.ndarray]] = []
    at = 0
    while at + THRESHOLD <= len(data):
        # Whole documents as far as they fit, or a stretch of a long one that overlaps the next.
        upto = offsets[np.searchsorted(offsets, at + STRETCH, side="right") - 1]
        if upto > at:
            stop = step = int(upto)
        else:
            stop = min(at + STRETCH, int(offsets[np.searchsorted(offsets, at, side="right")]))
            step = stop if stop in offsets else stop - THRESHOLD + 1
        n = stop - at - THRESHOLD + 1
        if n > 0:
            starts = np.arange(at, at + n)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            got = runs(data[at:stop], starts + THRESHOLD <= offsets[doc + 1])
            got["doc"] = doc[got["first"]]
            shift = at - offsets[got["doc"]]
            for c in ("first", "last", "anchor"):
                got[c] = got[c] + shift
            parts.append(got)
        at = step
    names = ("first", "last", "anchor", "gram", "context", "left", "right", "doc")
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, "int64") for c in names}


def _not_first(keys: list[np.ndarray], doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows behind the least (doc, row, at) of their key; equals of the least are not behind it."""
    order = np.lexsort((at, row, doc, *keys))
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys]) if len(order) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same])[:len(order)], np.arange(len(order)), 0))
    out = np.zeros(len(doc), dtype=bool)
    out[order] = np.logical_or.reduce([x[order] != x[order[head]] for x in (doc, row, at)])
    return out


def _frequent(docs: DataFrame) -> np.ndarray:
    """Grams that many documents of a small sample hold: at most NOTED, used only to deal work out."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = slice_runs(part.column("text"))
                pairs = np.unique(np.stack([got["gram"], got["doc"]]), axis=1)[0]
                yield pa.RecordBatch.from_arrays([pa.array(pairs)], ["gram"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_EVERY)) == 0).select("text")
    top = sample.mapInArrow(grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r["gram"] for r in top.orderBy(F.desc("n"), "gram").limit(NOTED).collect()], dtype="int64"))


def _run_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r = slice_runs(part.column("text"))
                doc, row = (filled_ids(part, c)[r["doc"]] for c in ("doc", "row"))
                done = _not_first([r["gram"], r["context"]], doc, row, r["first"])
                wide = np.isin(r["gram"], frequent)
                with np.errstate(over="ignore"):
                    spread = np.where(done, (doc ^ row) * np.int64(1_000_003) + r["first"], r["gram"] + (r["context"] & np.int64(PARTS - 1)))
                    key = np.where(done | wide, mix(spread.astype("uint64")).astype("int64"), r["gram"])
                place = (r["first"] << _FIRST | (r["last"] - r["first"]) << _MORE | (r["anchor"] - r["first"]) << _ANCHOR
                         | r["left"] << _LEFT | r["right"] << _RIGHT | wide.astype("int64") << _WIDE | done.astype("int64"))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(r["context"]), pa.array(doc), pa.array(row), pa.array(place)],
                                                 ["key", "context", "doc", "row", "place"])

    return docs.select("doc", "row", "text").mapInArrow(rows, ROW)


def _field(shift: int, bits: int):
    return F.shiftright("place", shift).bitwiseAND(F.lit((1 << bits) - 1))


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """doc, row, at, n, known: windows ``at`` to ``at + n - 1`` are repeats (known) or have to be looked at one by one."""
    done, wide = _field(_DONE, 1) == 1, _field(_WIDE, 1) == 1
    order = Window.partitionBy("key", "context").orderBy("doc", "row", F.shiftright("place", _FIRST))
    seen = rows.withColumn("rank", F.rank().over(order)).withColumn("peers", F.count("*").over(Window.partitionBy("key")))
    left = seen.filter((F.col("peers") > 1) | done | wide).withColumn("first", (F.col("rank") == 1).cast("int"))
    for side, shift in (("left", _LEFT), ("right", _RIGHT)):
        left = left.withColumn(side, _field(shift, SIDE_BITS))
        left = left.withColumn(f"{side}_shared", wide | (F.sum("first").over(Window.partitionBy("key", side)) > 1))
    at, more = F.shiftright("place", _FIRST), _field(_MORE, 7)
    middle = at + _field(_ANCHOR, 7) - HALF
    known = done | (F.col("rank") > 1)
    low = F.when(known | F.col("left_shared"), at).otherwise(F.greatest(at, middle))
    high = F.when(known | F.col("right_shared"), at + more).otherwise(F.least(at + more, middle))
    needed = known | F.col("left_shared") | F.col("right_shared")
    return left.filter(needed).select("doc", "row", low.alias("at"), (high - low + 1).alias("n"), known.alias("known")).filter("n > 0")


def _sorted_windows(docs: DataFrame, pending: DataFrame) -> DataFrame:
    """doc, row, at, n of the repeats among single windows."""
    wanted = pending.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                ids, own_rows = filled_ids(part, "doc"), filled_ids(part, "row")
                out = []
                spans = part.column("spans")
                flat, ends = spans.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(spans).to_numpy(zero_copy_only=False))])
                first, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for i in range(part.num_rows):
                    a, k = first[ends[i]:ends[i + 1]], n[ends[i]:ends[i + 1]]
                    at = np.unique(np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum()))
                    own = data[offsets[i]:offsets[i + 1]]
                    for some in np.split(at, np.searchsorted(at, np.arange(STRETCH, len(own), STRETCH))):
                        if len(some):
                            d1, d2 = windows(own[some[0]:some[-1] + THRESHOLD], some - some[0])
                            out.append((d1.view("int64"), d2.view("int64"), np.full(len(some), ids[i]), np.full(len(some), own_rows[i]), some))
                if not out:
                    continue
                d1, d2, doc, row, at = (np.concatenate(x) for x in zip(*out, strict=True))
                done = _not_first([d1, d2], doc, row, at)
                with np.errstate(over="ignore"):
                    d1 = np.where(done, mix(((doc ^ row) * np.int64(1_000_003) + at).astype("uint64")).astype("int64"), d1)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(doc), pa.array(row), pa.array(at << 1 | done)],
                                                 ["key", "context", "doc", "row", "place"])

    found = docs.join(wanted, ["doc", "row"]).select("doc", "row", "text", "spans").mapInArrow(rows, ROW)
    rank = F.rank().over(Window.partitionBy("key", "context").orderBy("doc", "row", "place"))
    return found.withColumn("rank", rank).filter((F.col("rank") > 1) | (F.col("place") % 2 == 1)).select(
        "doc", "row", F.shiftright("place", 1).alias("at"), F.lit(1).cast("long").alias("n"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc``, ``row``: what tells documents apart and orders them.

    ``doc`` is doc_id, with the smallest long for a null one.  ``row`` tells the texts of an id apart by their hash; rows
    without an id are written once with a number each, as read, so that copies among them differ, too.
    """
    least, doc = F.lit(-(1 << 63)), F.col("doc_id").cast("long")
    named = docs.filter(doc.isNotNull()).withColumns({"doc": doc, "row": F.xxhash64("text")})
    free = docs.filter(doc.isNull()).withColumns({"doc": least, "row": least + F.monotonically_increasing_id()})
    return named.union(hold(free, "repeats-unnamed"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, row, spans: places (at, n) of all windows of ``keyed`` documents that start earlier too.

    Earlier is in a smaller doc_id, another row of it by order of their keys, or before in the same text.  A null doc_id
    comes first, each such row a document of its own.  Rows that share doc_id and text are repeats of one document, none
    of them earlier.  Windows are of UTF-8 bytes and never cross documents.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "doc", "row", "text")
    first = hold(_sorted_runs(_run_rows(docs, _frequent(docs))), "repeats-runs")
    release(spark)
    second = hold(_sorted_windows(docs, first.filter(~F.col("known"))), "repeats-windows")
    release(spark)
    both = first.filter("known").select("doc", "row", "at", "n").union(second)
    return both.groupBy("doc", "row").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def cover(n_bytes: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs (start, stop) that windows ``at`` to ``at + n - 1`` cover."""
    order = np.argsort(at, kind="stable")
    a, b = at[order], np.maximum.accumulate(at[order] + n[order] - 1 + THRESHOLD)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], np.minimum(b[np.append(np.flatnonzero(new)[1:], len(a)) - 1], n_bytes)


def without_repeats(docs: DataFrame, digest, schema: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document and what ``digest(data, starts, stops)`` makes of its bytes and removed runs."""
    names = [c.split()[0] for c in schema.split(", ")]
    docs = keyed(docs)
    joined = docs.join(repeated_windows(docs), ["doc", "row"], "left").select(*keep, F.col("text").alias("_text"), F.col("spans").alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, "int64")
        for batch in batches:
            for part in slices(batch, "_text"):
                data, offsets = utf8(part.column("_text"))
                spans = part.column("_spans")
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))]).astype(int)
                flat = spans.flatten()
                at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                out = []
                for i in range(part.num_rows):
                    own, s = data[offsets[i]:offsets[i + 1]], slice(ends[i], ends[i + 1])
                    out.append(digest(own, *(cover(len(own), at[s], n[s]) if ends[i + 1] > ends[i] else (none, none))))
                made = [pa.array(list(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names)

    return joined.mapInArrow(run, schema)


def kept_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    edges = np.zeros(len(data) + 1, dtype="int8")
    edges[starts] += 1
    edges[stops] -= 1
    return data[np.cumsum(edges[:-1]) == 0].tobytes()


def digest_row(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, int, str]:
    return len(data), int((stops - starts).sum()), len(starts), hashlib.sha256(kept_bytes(data, starts, stops)).hexdigest()


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; a null text is empty."""
    return without_repeats(docs.select(F.col("doc_id").cast("long"), "text"), digest_row,
                           "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"])


def kept_text(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[str, int]:
    text = kept_bytes(data, starts, stops).decode("utf-8", "ignore")
    return text, len(text)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) with repeated bytes removed from their texts, and n_chars.

    A character of which only some bytes are left goes as a whole.  Documents of nothing but repeats stay, empty.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    made = without_repeats(rows, kept_text, "doc_id long, lang string, source string, text string, n_chars long", ["doc_id", "lang", "source"])
    return made.select("doc_id", "text", "lang", "source", "n_chars")
