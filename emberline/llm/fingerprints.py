"""MinHash fingerprints of documents and near duplicates by banded signatures.

A document's words (A-Z folded) give five-word shingles; each of 128 universal hash permutations of the 64-bit
shingle hashes, x -> a x + b with odd a, keeps its minimum, of which 16 bits stay.  Equal positions of two
fingerprints estimate the Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.batches import mix, shingle_hashes, slices, split_words, word_hashes
from emberline.llm.ngramjoin import spanning_links
from emberline.operators.components import min_label
from emberline.session import hold, shuffle_width

SHINGLE_WORDS = 5
PERMUTATIONS = 128
BANDS = 32
THRESHOLD = 0.8
#: Value of every position where there is no shingle; no hash has it.
EMPTY = np.uint16(0xFFFF)
#: Shingles hashed together, so that the work stays in the processor's cache.
CHUNK = 1 << 15


def coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 1 << 63, size=(2, n), dtype="int64").astype("uint64")
    return draw[0] << np.uint64(1) | np.uint64(1), draw[1]


def shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, repeats included, and each text's offsets."""
    codes, offsets, distinct = split_words(texts, lower=True)
    return shingle_hashes(word_hashes(distinct)[codes], offsets, SHINGLE_WORDS)


def signatures(texts: pa.Array, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of ``permutations`` 16-bit minima for each text; ``EMPTY`` throughout where there is no word."""
    hashes, offsets = shingled(texts)
    out = np.full((len(texts), permutations), EMPTY, dtype="uint16")
    a, b = coefficients(permutations)
    full = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(full):
        start = offsets[full[at]]
        n = max(1, int(np.searchsorted(offsets[full[at:] + 1], start + CHUNK, side="right")))
        own = full[at:at + n]
        x = hashes[start:offsets[own[-1] + 1]]
        first = offsets[own] - start
        t = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(permutations):
                np.multiply(x, a[k], out=t)
                np.add(t, b[k], out=t)
                # The low bits of a minimum are as good as random; the high ones are all near zero.
                low = (mix(np.minimum.reduceat(t, first)) & np.uint64(0xFFFF)).astype("uint16")
                out[own, k] = np.minimum(low, EMPTY - 1)
        at += n
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal positions of paired signatures; two empty documents are alike."""
    return (left == right).mean(axis=1)


def as_text(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def successor_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Deal documents out by ranges of descending doc_id, each range followed by its successor's first rows.

    Adds ``k`` (range) and ``tail``: rows of a range in order have ``tail`` false; those with ``tail`` true, first in
    the next range, are there once more so that the range's last document finds its successor.  After the last range
    comes the first.  Range bounds come from the ids alone; the texts are shuffled once.  A null doc_id is last.
    """
    ids = docs.select(F.col("doc_id").cast("long"))
    cuts = np.array(sorted(set(ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) or [])), "int64")

    def place(doc_id: pd.Series) -> np.ndarray:
        known = doc_id.notna().to_numpy()
        k = np.full(len(doc_id), -1, dtype="int64")
        k[known] = np.searchsorted(cuts, doc_id[known].to_numpy().astype("int64"), side="right")
        return k

    @F.pandas_udf("long")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(place(doc_id))

    # One row for each range: its number and its greatest id.
    heads = sorted(ids.groupBy(range_of("doc_id").alias("k")).agg(F.max("doc_id").alias("head")).collect(), reverse=True)
    before = {heads[(i + 1) % len(heads)]["k"]: r["k"] for i, r in enumerate(heads)}
    head = {r["k"]: r["head"] for r in heads}

    @F.pandas_udf("array<struct<k:long,tail:boolean>>")
    def places(doc_id: pd.Series) -> pd.Series:
        out = []
        for k, d in zip(place(doc_id).tolist(), doc_id, strict=True):
            own = [(k, False)]
            if head[k] is None or d == head[k]:
                own.append((before[k], True))
            out.append(own)
        return pd.Series(out)

    spread = docs.select(F.col("doc_id").cast("long"), "text", F.inline(places(F.col("doc_id").cast("long"))))
    return spread.repartition("k").sortWithinPartitions("k", "tail", F.col("doc_id").desc_nulls_last(), "text")


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last third of the code points makes way for as many, or all there are, of the next document's first,
    in descending doc_id; after the last comes the first.  A null text is empty; equal ids follow each other by
    text; a single document follows itself; an empty table gives no rows.  Two texts without words are alike.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EDITED.split(", ")]
        carried: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                cols = [part.column(c).to_pylist() for c in ("doc_id", "k", "tail")]
                texts = pc.fill_null(part.column("text").cast(pa.string()), "")
                rows = carried + list(zip(*cols, texts.to_pylist(), signatures(texts), strict=True))
                carried = rows[-1:]
                out = [(r, n) for r, n in zip(rows, rows[1:]) if not r[2] and r[1] == n[1]]
                if not out:
                    continue
                edited = []
                for r, n in out:
                    cut = len(r[3]) // 3
                    edited.append(r[3][:len(r[3]) - cut] + n[3][:cut])
                own, after = np.stack([r[4] for r, _ in out]), np.stack([n[4] for _, n in out])
                changed = np.concatenate([signatures(p.column(0)) for p in slices(
                    pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], ["text"]))])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r, _ in out], pa.int64()), pa.array([len(r[3]) for r, _ in out], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                    pa.array(as_text(own)), pa.array(as_text(changed)),
                    pa.array(likeness(own, changed)), pa.array(likeness(own, after))], names)

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], EDITED)
    return successor_ranges(docs, 4 * shuffle_width(docs.sparkSession)).mapInArrow(run, EDITED)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """doc_id, class_id: documents linked by a verified Jaccard similarity, named by their least doc_id.

    Documents of equal shingle sets are one class from the start, so a large group of copies is one row later on.
    Signatures are cut in bands; those who share a band are candidates.  All are verified on their whole sets with the
    least member of the band's bucket, which makes one component of most buckets.  The others are compared as a whole in
    blocks, so every link within a bucket counts.  Documents without words stay alone; a null doc_id is dropped, repeated
    rows of a doc_id give one row.
    """
    width = PERMUTATIONS // bands

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, offsets = shingled(part.column("text"))
                sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
                sig = signatures(part.column("text"))
                keys = [[row[i:i + width].tobytes() for i in range(0, PERMUTATIONS, width)] if len(s) else [] for row, s in zip(sig, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(digest), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.binary()))], ["doc_id", "set_id", "shingles", "bands"])

    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    facts = hold(ids.mapInArrow(describe, "doc_id long, set_id string, shingles array<long>, bands array<binary>"), "minhash")
    empty = F.size("shingles") == 0
    reps = hold(facts.filter(~empty).groupBy("set_id").agg(F.min("doc_id").alias("rep")), "minhash-reps")
    sets = facts.join(reps, "set_id").filter("doc_id = rep").dropDuplicates(["rep"]).select("rep", "shingles", "bands")
    buckets = hold(sets.select("rep", F.posexplode("bands").alias("band", "key")), "minhash-bands")
    least = buckets.groupBy("band", "key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = hold(buckets.join(least, ["band", "key"]).filter("a < rep").select("a", F.col("rep").alias("b")).distinct(), "minhash-pairs")
    left, right = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    links = hold(pairs.join(left, "a").join(right, "b").filter(
        both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "minhash-links")
    links = links.union(_within(buckets, sets, links, threshold))
    known = facts.select("doc_id", "set_id").distinct().join(reps, "set_id", "left")
    if links.isEmpty():
        return known.groupBy("doc_id").agg(F.min(F.coalesce("rep", "doc_id")).alias("class_id"))
    roots = min_label(links).select(F.col("node").alias("rep"), "label")
    return known.join(roots, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep", "doc_id")).alias("class_id"))


def _within(buckets: DataFrame, sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Links of the buckets whose members the links with their least ones leave apart; equal buckets are read once."""
    component = F.col("rep")
    if not links.isEmpty():
        buckets = buckets.join(min_label(links).withColumnRenamed("node", "rep"), "rep", "left")
        component = F.coalesce("label", "rep")
    apart = buckets.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min(component).alias("low"), F.max(component).alias("high"),
        F.xxhash64(F.count("*"), F.min("rep"), F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64("rep", F.lit(1)))).alias("k"),
    ).filter("n > 2 and low < high").select("band", "key", "k")
    chosen = buckets.join(apart, ["band", "key"]).select("k", "rep").distinct()
    return spanning_links(hold(chosen.join(sets, "rep").select(
        "rep", "k", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("members")), "minhash-apart"), round(100 * threshold, 9))
