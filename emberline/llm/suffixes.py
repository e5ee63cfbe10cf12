"""Suffixes of documents as hashes of their leading bytes, and the sieve that names those worth sorting.

A window is a string of THRESHOLD bytes.  Its anchor is the gram of GRAM bytes inside it with the least hash, the last
one among equals, so equal windows have equal anchors in the same place.  Windows with one anchor follow each other
and form a run; the bytes that a run covers are its context.
"""

from __future__ import annotations

import numpy as np

from emberline.llm.batches import mix

THRESHOLD = 100
GRAM = 20
HALF = (THRESHOLD - GRAM) // 2
SIDE_BITS = 8
#: Bytes hashed together; a longer document is taken in overlapping stretches.
STRETCH = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


class Rolling:
    """Hashes of all substrings of fixed lengths, built from those of half the length."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.base = _BASES[which]
        table = mix(np.arange(256, dtype="uint64") * np.uint64(0xA24BAED4963EE407) + np.uint64(which + 1))
        self.levels = [table[data]]

    def level(self, k: int) -> np.ndarray:
        """Hashes of the substrings of 2^k bytes."""
        while len(self.levels) <= k:
            h, n = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(h[:-n] * np.uint64(pow(self.base, n, 1 << 64)) + h[n:] if len(h) > n else h[:0])
        return self.levels[k]

    def of(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the substrings of ``length`` bytes, at all places or at those given."""
        out, done = None, 0
        count = max(0, len(self.levels[0]) - length + 1)
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                h = self.level(k)
                h = h[done:done + count] if at is None else h[at + done]
                out = h if out is None else out * np.uint64(pow(self.base, 1 << k, 1 << 64)) + h
                done += 1 << k
        return mix(out)


def least_last(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbours."""
    span = 1
    m = key
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def runs(data: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of the valid windows of some bytes: first, last, anchor (places), gram, context, left, right (hashes).

    ``left`` and ``right`` are short hashes of the HALF bytes before and after the anchor's gram.  A window that starts
    HALF bytes or more before its anchor holds all of the left ones, any other all of the right ones.
    """
    with np.errstate(over="ignore"):
        one, two = Rolling(data, 0), Rolling(data, 1)
        grams = one.of(GRAM)
        bits = np.uint64(max(1, int(len(grams)).bit_length()))
        # The place counts down in the low bits: among equal hashes the last is least.
        low = (np.uint64(1) << bits) - np.uint64(1)
        key = (grams & ~low) | (low - np.arange(len(grams), dtype="uint64"))
        at = np.flatnonzero(valid)
        best = least_last(key, THRESHOLD - GRAM + 1)[at]
        new = np.concatenate([[True], (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)])[:len(at)]
        first = at[new]
        last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else first
        anchor = (low - (best[new] & low)).astype("int64")
        context = mix(one.of(THRESHOLD, first) * np.uint64(3) + two.of(THRESHOLD, last) * np.uint64(5)
                      + (last - first).astype("uint64") * np.uint64(0x2545F4914F6CDD1D) + (anchor - first).astype("uint64"))
        reach = len(data) - HALF
        sides = [two.of(HALF, np.clip(anchor + d, 0, reach)) >> np.uint64(64 - SIDE_BITS) for d in (-HALF, GRAM)]
        return {"first": first, "last": last, "anchor": anchor, "gram": grams[anchor].view("int64"),
                "context": context.view("int64"), "left": sides[0].astype("int64"), "right": sides[1].astype("int64")}


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digits of the windows that start at ``at``: hashes of their first half and of their second."""
    half = THRESHOLD // 2
    with np.errstate(over="ignore"):
        return Rolling(data, 0).of(half, at), Rolling(data, 1).of(THRESHOLD - half, at + half)
