"""Periodic runs against brute force over all periods and stretches."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, times=3):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                own = words[i:j + q]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 40), st.integers(1, 4), st.booleans()), max_size=6), st.integers(0, 2**32 - 1))
def test_runs_against_brute_force(pieces, seed):
    rng = np.random.default_rng(seed)
    words = []
    for period, length, alphabet, noise in pieces:
        unit = rng.integers(0, alphabet, period).tolist()
        words += (unit * length)[:length + 12]
        if noise:
            words += (100 + rng.integers(0, 50, 5)).tolist()
    got = periodic.runs_of(np.array(words, "int64"), np.zeros(len(words), "int64"))
    assert [(a, b - a, q) for a, b, q in got] == brute_runs(words)


def test_nested_and_long_periods():
    rng = np.random.default_rng(4)
    inner = [1] * 30 + rng.integers(10, 40, 50).tolist()
    words = inner * 4 + inner[:17] + [99] + [5, 6] * 400 + [7] + [5, 6] * 12
    long = rng.integers(0, 1000, 700).tolist()
    words += long * 3 + long[:699]
    docs = np.repeat([0, 3], [len(words), 26])
    words += [5, 6] * 13
    got = [(a, b - a, q) for a, b, q in periodic.runs_of(np.array(words), docs)]
    cut = len(words) - 26
    assert got == brute_runs(words[:cut]) + [(cut, 26, 2)]


def test_lag_scan_looks_grow_with_the_text_and_not_its_square():
    words = np.zeros(400_000, "int64")
    assert periodic.runs_of(words, np.zeros(len(words), "int64")) == [(0, 400_000, 1)]
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 200_000)
    assert periodic.runs_of(words, np.zeros(len(words), "int64")) == []


def test_query_against_brute_force(spark, corpus, documents):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    rng = np.random.default_rng(2)
    rows += [(10_000 + i, " ".join(f"w{x}" for x in (rng.integers(0, 30, int(rng.integers(1, 40))).tolist() * 9)[:int(rng.integers(1, 300))])) for i in range(150)]
    rows += [(None, "x y " * 20), (None, None), (7, None), (8, ""), (9, " \t\n"), (9, "a b " * 30), (10_001, "é  " * 24), (20, "la " * 23), (21, "la " * 24)]
    got = [tuple(r) for r in periodic.run_digests(documents(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute_row(*r)) for r in rows)
    assert sum(r[1] > 0 for r in got) > 50
    assert periodic.run_digests(documents([])).collect() == []


def test_collapsed_texts_and_spans(documents):
    text = "start " + "one two  three\n" * 12 + "end"
    (r,) = periodic.periodic_runs(documents([(3, text)])).collect()
    assert [tuple(x) for x in r["runs"]] == [(1, 36, 3)] and r["n_words"] == 38 and r["collapsed"] == "start one two three end"
