"""Arrow helpers shared by the text operators: bounded slices, words, Python-side caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text worked on at once inside a batch.
SLICE_BYTES = 4 << 20


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, so that tasks after the first find warm entries."""
    return sys.modules.setdefault("_emberline_worker_cache", types.ModuleType("cache")).__dict__


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), limit, side="right")))
        yield batch.slice(at, n)
        at += n


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between runs of U+0020 and U+0009 to U+000D: codes, document offsets, distinct words.

    ``lower`` folds A-Z only.  A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    ahead = np.concatenate([[0], np.cumsum(full)])
    return coded.indices.to_numpy(zero_copy_only=False)[full], ahead[offsets].astype("int64"), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_numpy(zero_copy_only=False)), "uint64", len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one, so that close values end far apart."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each document, and their document offsets.

    A document with fewer words, but at least one, has its whole sequence as its only shingle.
    ``words`` are word hashes.  Repeats stay.
    """
    counts = np.diff(offsets)
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(out)]).astype("int64")
    first = np.repeat(offsets[:-1] - to[:-1], out) + np.arange(to[-1])
    length = np.repeat(np.minimum(counts, size), out)
    h = np.zeros(to[-1], dtype="uint64")
    last = max(len(words) - 1, 0)
    with np.errstate(over="ignore"):
        for k in range(size):
            if not len(words):
                break
            w = words[np.minimum(first + k, last)] + np.uint64(2 * k + 1)
            h = np.where(length > k, h * np.uint64(0x9E3779B97F4A7C15) + w, h)
        return mix(h ^ (length.astype("uint64") << np.uint64(56))), to


def filled_ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """Ids as int64; a null one is the smallest long."""
    return pc.fill_null(batch.column(column).cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)
