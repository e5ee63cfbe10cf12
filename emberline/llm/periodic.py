"""Periodic runs of words, by recursive frequency splitting and a lag scan of what is left.

A run is a stretch of words with smallest period q that holds at least ``TIMES`` periods and ``LEAST`` words and that no
neighbouring word extends.  Each of its words occurs ``TIMES`` times in it, so a word that is rarer than that within the
current segment is in no run: such words split the segment.  The parts are counted anew until nothing splits; parts
shorter than ``LEAST`` go.  Ordinary prose is gone after two or three rounds.

What survives is scanned lag by lag.  A run of period q shows as a stretch of at least max(LEAST - q, (TIMES - 1) q)
positions whose words equal those q further on, hence as equal grams at one of the places of a grid that is about as wide
as that.  The places of all lags are a harmonic sum, so a segment of n words costs n log n looks and not n squared.
Places within a known run whose period divides the lag show that run again and are passed over; the others are
extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.batches import mix, slices, split_words

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
WORD = r"[^\x20\x09-\x0D]+"
FOUND = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"


def frequent_segments(words: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that no round of splitting took, ascending, and the number of each one's segment."""
    at, seg = np.arange(len(words)), doc.astype("int64")
    width = int(words.max(initial=0)) + 1
    done_at, done_seg, named = [], [], 0
    while len(at):
        _, back, count = np.unique(seg * width + words[at], return_inverse=True, return_counts=True)
        keep = count[back] >= times
        # A segment that loses no word is stable.
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        size = np.diff(np.append(first, len(seg)))
        whole = np.repeat((np.add.reduceat(keep.astype("int64"), first) == size) & (size >= least), size)
        if whole.any():
            own = seg[whole]
            number = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]])) + named
            done_at.append(at[whole])
            done_seg.append(number)
            named = int(number[-1]) + 1
        left = keep & ~whole
        at, seg = at[left], seg[left]
        if not len(at):
            break
        cut = np.concatenate([[True], (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)])
        seg = np.cumsum(cut) - 1
        long = np.bincount(seg)[seg] >= least
        at, seg = at[long], seg[long]
    if not done_at:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    return np.concatenate(done_at), np.concatenate(done_seg)


def _matching(words: np.ndarray, a: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``a`` within [low, high) whose words equal those ``q`` further on."""
    end, step = a, 64
    while end < high - q:
        n = min(step, high - q - end)
        differ = np.flatnonzero(words[end:end + n] != words[end + q:end + q + n])
        end += int(differ[0]) if len(differ) else n
        if len(differ):
            break
        step *= 2
    start, step = a, 64
    while start > low:
        n = min(step, start - low)
        differ = np.flatnonzero(words[start - n:start] != words[start - n + q:start + q])
        start -= n - 1 - int(differ[-1]) if len(differ) else n
        if len(differ):
            break
        step *= 2
    return start, end


def lag_scan(words: np.ndarray, seg: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of consecutive segments; ``seg`` numbers each word's."""
    if not len(words):
        return []
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    size = np.diff(np.append(first, len(seg)))
    # Longest segments first, so that those which can hold a lag stand in front.
    order = np.argsort(-size, kind="stable")
    place = np.repeat(first[order] - np.concatenate([[0], np.cumsum(size[order])[:-1]]), size[order]) + np.arange(len(words))
    words, ends = words[place], np.cumsum(size[order])
    starts, owner = ends - size[order], np.repeat(np.arange(len(size)), size[order])
    gram = max(1, (times - 1) * least // times // 2)
    hashes = owner.astype("uint64")
    with np.errstate(over="ignore"):
        n = len(words) - gram + 1
        hashes = mix(hashes[:n] + np.uint64(1))
        for k in range(gram):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n].astype("uint64")
    found: list[tuple[int, int, int]] = []
    known = np.zeros((3, 0), "int64")
    for q in range(1, int(size.max()) // times + 1):
        until = int(ends[np.searchsorted(-size[order], -max(least, times * q), side="right") - 1])
        grid = np.arange(0, min(until, n) - q, max(least - q, (times - 1) * q) - gram + 1)
        hit = grid[hashes[grid] == hashes[grid + q]]
        if not len(hit):
            continue
        same = known[:, q % known[2] == 0] if known.shape[1] else known
        if same.shape[1]:
            by = np.argsort(same[0], kind="stable")
            before = np.searchsorted(same[0][by], hit, side="right") - 1
            reach = np.maximum.accumulate(same[1][by])
            hit = hit[(before < 0) | (reach[before] <= hit + q)]
        new, past = [], -1
        for a in hit.tolist():
            if a < past:
                continue
            s = owner[a]
            low, past = _matching(words, a, q, int(starts[s]), int(ends[s]))
            if past - low >= max(least - q, (times - 1) * q):
                new.append((low, past + q, q))
            past = max(past, a + 1)
        if new:
            found += new
            known = np.concatenate([known, np.array(new, "int64").T], axis=1)
    return [(int(place[a]), int(place[a]) + b - a, q) for a, b, q in found]


def runs_of(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of all documents' words in a row, by document, start and period."""
    at, seg = frequent_segments(words, doc)
    order = np.lexsort((at, seg))
    at, seg = at[order], seg[order]
    return sorted((int(at[a]), int(at[a]) + b - a, q) for a, b, q in lag_scan(words[at], seg))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period), collapsed of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0.  ``collapsed`` joins by one space the words that are
    in no run or among the first ``period`` words of every run that holds them.  A null or empty text has no words and
    an empty ``collapsed``; rows with a null or repeated doc_id each keep a row.  Other columns play no part.
    Nothing is shuffled; a text is held by one task, with a few numbers a word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, offsets, names = split_words(part.column("text"))
                count = np.diff(offsets)
                doc = np.repeat(np.arange(part.num_rows), count)
                found = np.array(runs_of(codes, doc), "int64").reshape(-1, 3)
                start, end, period = found.T
                owner = doc[start] if len(start) else np.zeros(0, "int64")
                drop = np.zeros(len(codes) + 1, "int64")
                np.add.at(drop, start + period, 1)
                np.add.at(drop, end, -1)
                kept = np.cumsum(drop)[:-1] == 0
                to = np.concatenate([[0], np.cumsum(kept)])[offsets].astype("int32")
                left = pa.ListArray.from_arrays(pa.array(to), names.take(pa.array(codes[kept])))
                spans = pa.StructArray.from_arrays(
                    [pa.array(start - offsets[owner]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype("int32")
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(count), pa.ListArray.from_arrays(pa.array(ends), spans),
                    pc.binary_join(left, " ")], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text of the query: of every tenth document, by checksum of its id, the words from some place on repeat.

    A document without an id stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text.

    The greatest exponent length / period is found exactly, by the products that order two fractions; ties go to the
    smallest start, then period.  Without a run the four columns of the greatest are null.
    """
    text = with_planted_period(F.col("doc_id"), F.col("text")).alias("text")
    found = periodic_runs(docs.select("doc_id", text))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, r: Column) -> Column:
        # Runs come by start and period, so only a truly greater one takes over.
        ahead = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | ahead, r).otherwise(best)

    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
