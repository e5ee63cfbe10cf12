"""Fingerprints, repeated bytes and the Jaccard join against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import fingerprints, ngramjoin, repeats, suffixes

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strange potion of bitter roots and honey "


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for i, (doc_id, _) in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        cut = len(t) // 3
        out.append((doc_id, len(t), hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_follow_the_contract(documents, corpus):
    small = [(4, PROSE), (9, None), (2, ""), (7, "é" * 10), (4, PROSE), (None, "last of all"), (11, PROSE * 300)]
    large = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    for rows, df in ((small, documents(small)), (large, corpus), ([(1, PROSE)], documents([(1, PROSE)]))):
        got = fingerprints.edited_fingerprints(df).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edited(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.edited_fingerprints(documents([])).collect() == []


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 1 << 30, 3000)]
    for kept in (3000, 2400, 1500, 0):
        other = words[:kept] + [f"v{i}" for i in range(3000 - kept)]
        sig = fingerprints.signatures(pa.array([" ".join(words), " ".join(other)]))
        a, b = (set(zip(*(w[i:] for i in range(5)))) for w in (words, other))
        assert abs(fingerprints.likeness(sig[:1], sig[1:])[0] - len(a & b) / len(a | b)) < 0.15
    sig = fingerprints.signatures(pa.array(["A b", "a  B", "", None]))
    assert (sig[0] == sig[1]).all() and (sig[2] == sig[3]).all() and not (sig[0] == sig[2]).any()


def test_near_duplicates_by_bands(documents):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words)) for i in (5, 8, 11)] + [(3, " ".join([*words[:295], "x"])), (2, "quite another text of some words"), (1, ""), (6, None)]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(documents(rows)).collect()}
    assert got == {5: 3, 8: 3, 11: 3, 3: 3, 2: 2, 1: 1, 6: 6}
    assert fingerprints.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("block", [ngramjoin.BLOCK_SETS, 7])
def test_near_duplicates_among_excerpts_against_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", block)
    rng = np.random.default_rng(21)
    rows = []
    for family in range(4):
        lines = [" ".join(f"f{family}w{rng.integers(1 << 30)}" for _ in range(12)) for _ in range(40)]
        rows += [(100 * family + i, "\n".join(lines[k] for k in np.sort(rng.permutation(40)[:28]))) for i in range(30)]
        rows += [(100 * family + 50, "\n".join(lines)), (100 * family + 51, "\n".join(lines[:39]))]
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    want = {i: min(j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
    assert [want[100 * f + 51] for f in range(4)] == [50, 150, 250, 350]
    assert {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(documents(rows)).collect()} == want


def brute_repeats(rows):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        hit = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            at = seen.setdefault(raw[s:s + 100], (doc_id, s))
            if at != (doc_id, s):
                hit[s:s + 100] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, "uint8")[~hit].tobytes()
        out[doc_id] = (len(raw), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes_against_brute_force(documents, corpus, monkeypatch):
    rng = np.random.default_rng(5)
    fresh = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = fresh(130)
    small = [(3, fresh(80) + shared + fresh(90)), (1, shared), (8, shared[5:110] + fresh(40) + shared[:99]), (6, "z" * 700), (2, None),
             (4, ""), (7, fresh(99)), (None, fresh(50) + shared[20:125]), (9, "ü" * 240 + shared), (10, fresh(300)), (5, shared * 4)]
    small += [(20 + i, fresh(30) + shared + fresh(30)) for i in range(30)]
    large = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    for rows, df in ((small, documents(small)), (large, corpus), ([(1, fresh(300)), (1, fresh(300))][:1] * 2, None)):
        df = df or documents(rows)
        got = repeats.repeat_digests(df).collect()
        want = brute_repeats(rows)
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:] == want[r["doc_id"]]
    assert repeats.repeat_digests(documents([])).collect() == []


def test_texts_of_one_id_or_of_none_are_documents_of_their_own(documents):
    rng = np.random.default_rng(9)
    fresh = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared, twin = fresh(130), fresh(240)
    rows = [(None, fresh(500) + shared + fresh(70)), (None, fresh(900)), (None, fresh(120)), (None, shared + fresh(20)), (None, twin), (None, twin),
            (None, None), (None, "brief"), (4, fresh(150)), (7, fresh(300) + shared), (7, fresh(900)), (7, fresh(40) + twin[:150]), (9, shared)]
    df = documents(rows)
    rank = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    # Rows without an id come first, as read; those of one id by the hash of their texts.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i if rows[i][0] is None else rank[rows[i][1]]))
    want = brute_repeats([(n, rows[i][1]) for n, i in enumerate(order)])
    got = repeats.repeat_digests(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((rows[i][0], *want[n])) for n, i in enumerate(order))
    kept = [(r["doc_id"], r["text"]) for r in repeats.deduplicated(df).collect()]
    assert len(kept) == len(rows) and kept.count((None, twin)) == 1 and kept.count((None, rows[1][1])) == 1


def test_frequent_grams_dealt_out_give_the_same(documents, monkeypatch):
    rng = np.random.default_rng(6)
    fresh = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = fresh(260)
    rows = [(i, fresh(60) + shared[i % 7:200 + i] + fresh(60)) for i in range(60)]
    monkeypatch.setattr(repeats, "SAMPLE_EVERY", 1)
    for r in repeats.repeat_digests(documents(rows)).collect():
        assert tuple(r)[1:] == brute_repeats(rows)[r["doc_id"]]


def test_long_documents_in_stretches_give_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(chr(97 + c) for c in rng.integers(0, 3, 5000))
    whole = repeats.slice_runs(pa.array([text, text[:2000]]))
    monkeypatch.setattr(repeats, "STRETCH", 700)
    parts = repeats.slice_runs(pa.array([text, text[:2000]]))
    for got in (whole, parts):
        covered = sorted((d, w) for d, a, b in zip(got["doc"], got["first"], got["last"], strict=True) for w in range(a, b + 1))
        assert covered == [(0, w) for w in range(4901)] + [(1, w) for w in range(1901)]


def test_kept_text_keeps_whole_characters(documents):
    shared = "é" * 60
    got = {r["doc_id"]: r["text"] for r in repeats.deduplicated(documents([(1, shared + "a"), (2, "b" + shared), (3, None)])).collect()}
    assert got[1].startswith("é") and got[2] == "b" and got[3] == ""


def shingles(text, n=4):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute_components(rows, n=4, numerator=85):
    sets = {d: shingles(t, n) for d, t in rows}
    name = {d: d for d in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= numerator * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            k = int(rng.integers(0, len(words)))
            words[k:k + 1] = [[], [f"n{rng.integers(1 << 30)}"], [words[k], "extra"]][int(rng.integers(0, 3))]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = np.random.default_rng(11)
    texts = []
    for size in (1, 3, 4, 8, 12, 15, 17, 18, 22, 40, 90, 200):
        for _ in range(3):
            base = [f"w{rng.integers(1 << 30)}" for _ in range(size)]
            texts += variants(rng, base, 8, 1 + size // 40)
    texts += ["", None, "  \n", "A b C d", "a B c D", "a b c", "A B C"]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_components_against_brute_force(documents, corpus, near_rows):
    large = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    for rows, df in ((near_rows, documents(near_rows)), (large, corpus)):
        want = brute_components(rows)
        got = ngramjoin.linked_components(df).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert ngramjoin.linked_components(documents([])).collect() == []


def test_groups_beyond_a_block_give_the_same(documents, near_rows, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{rng.integers(1 << 30)}" for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(variants(rng, base, 60, 6))]
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 7)
    for own in (rows, near_rows):
        got = ngramjoin.linked_components(documents(own)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(own)


def test_lists_in_passes_give_the_same(documents, near_rows, monkeypatch):
    # At 6 GB all entries, and all shared ones each with a sketch, stood on disk at once: over four times the texts.
    held = []

    def spied(df, name, hold=ngramjoin.hold):
        out = hold(df, name)
        held.append((name, {r["key"] for r in out.collect()} if name == "join-lists" else None))
        return out

    monkeypatch.setattr(ngramjoin, "hold", spied)
    monkeypatch.setattr(ngramjoin, "LEAST_MOVED", 16_000, raising=False)
    monkeypatch.setattr(ngramjoin, "ENTRIES_MOVED", 0, raising=False)
    monkeypatch.setattr(ngramjoin, "SKETCHED_MOVED", 4, raising=False)
    rows = near_rows[-110:]
    got = ngramjoin.linked_components(documents(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    keys = [k for name, k in held if name == "join-lists"]
    # No list is in two passes, and each pass has a share of them.
    assert len(keys) >= 2 and sum(map(len, keys)) == len(set().union(*keys)) > 100
    assert max(map(len, keys)) < 0.75 * sum(map(len, keys))
    assert sum(name == "join-far" for name, _ in held) >= 2


def brute_rows(rows, n=4, numerator=85):
    """As brute_components, with each row a text of its own: (doc_id, size, component_id) and the component's first row."""
    named = brute_components(list(enumerate(t for _, t in rows)), n, numerator)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            root = named[k][1]
            least[root] = min(doc_id, least.get(root, doc_id))
    return [(d, named[k][0], least.get(named[k][1]) if named[k][0] else d) for k, (d, _) in enumerate(rows)], [named[k][1] for k in range(len(rows))]


def test_rows_link_by_their_own_texts_whatever_their_ids(documents):
    word = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    a, other = "quite another text without a word in common with those that follow it here", word(0, 60)
    chain = [(1, word(0, 100)), (None, word(5, 105)), (2, word(10, 110))]
    rows = [*chain, (12, a), (12, other), (13, other + " one"), (None, "none has an id of these words at all"), (None, "none has an id of these words at all"),
            (None, ""), (14, None), (15, word(200, 230)), (None, word(200, 230)), (None, word(200, 229))]
    want, root = brute_rows(rows)
    assert [w[2] for w in want[:6]] == [1, 1, 1, 12, 12, 12]
    df = documents(rows).withColumn("_kept", F.lit(1)).withColumn("row", F.lit("x")).withColumn("set_id", F.lit(2))
    got = [tuple(r) for r in ngramjoin.linked_components(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = ngramjoin.one_of_each(df)
    assert kept.columns == df.columns
    groups = {k: {rows[i] for i in range(len(rows)) if root[i] == k} for k in root}
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(groups) and sorted(repr(f) for f in found if f in [(12, a), (14, None), (None, "")]) == sorted(map(repr, [(12, a), (14, None), (None, "")]))
    for own in groups.values():
        (stays,) = [f for f in found if f in own]
        assert stays[0] == min((d for d, _ in own if d is not None), default=None)


def test_other_sizes_and_shares(documents, near_rows):
    got = ngramjoin.linked_components(documents(near_rows), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(near_rows, 5, 80)


def test_null_and_repeated_ids(documents):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone in the world here"), (2, "A b c d e F")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.linked_components(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 3, 2), (4, 3, 2), (4, 3, 2), (None, 2, None), (2, 3, 2)], key=str)
    kept = ngramjoin.one_of_each(documents([(4, "x y"), (4, "x y"), (5, "x y"), (6, None)])).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [4, 6]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(0, 8), st.integers(0, 8), st.integers(0, 1 << 30), st.sampled_from([80, 85]))
def test_linking_sets_share_an_entry(common, only_a, only_b, seed, numerator):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 62, common + only_a + only_b).astype("uint64")
    a, b = np.sort(values[:common + only_a]), np.sort(np.concatenate([values[:common], values[common + only_a:]]))
    if 100 * common >= numerator * (common + only_a + only_b):
        who, keys = ngramjoin.entries(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), numerator)
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_boundary_is_where_subsets_get_dear():
    for numerator in (80, 85):
        small = ngramjoin.boundary(numerator)
        assert ngramjoin.subsets(small, numerator) < ngramjoin.subsets(small + 1, numerator)
    assert suffixes.GRAM < suffixes.THRESHOLD
