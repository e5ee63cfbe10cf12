"""Source divergence against brute force in whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    said = [(lang, source, Counter(TERM.findall(text.translate(LOWER)))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, c) for g, s, c in said if g == lang]
        docs = Counter(t for _, c in mine for t in c)
        kept = sorted(t for t, n in docs.items() if n >= 3)
        count = defaultdict(Counter)
        for s, c in mine:
            count[s].update({t: n for t, n in c.items() if docs[t] >= 3})
        whole = Counter()
        for c in count.values():
            whole.update(c)

        def p(c):
            total = sum(c.values())
            return [1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept]

        ps, q = {s: p(count[s]) for s, _ in mine}, p(whole)
        for s in ps:
            pair = [(-sum((x - y) ** 2 // y for x, y in zip(ps[s], ps[o])), o.encode(), o) for o in ps if o != s]
            term = [(-((x - y) ** 2 // y), t.encode(), t) for t, x, y in zip(kept, ps[s], q) if count[s][t] and x > y]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(term)[:top])]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, i, "x", 1.0) for i, r in enumerate(rows)], "lang string, source string, text string, doc_id long, term string, p double")
    return sorted(tuple(r) for r in divergence.source_divergence(df, **kw).collect())


def test_odd_rows_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = ["Alpha", "beta", "GAMMA", "été", "Über", "ΩMEGA", "mid-word", "it's", "x1y2", "日本", "a b", "\u0085", "zeta", "Σ"]
    rows = [(str(rng.choice(["en", "de"])), f"s{rng.integers(0, 5)}", " ".join(rng.choice(letters, int(rng.integers(0, 30))))) for _ in range(120)]
    rows += [(None, "a", "only twice"), (None, "b", "only twice"), ("fr", None, "un un un"), ("fr", "", "un deux"), ("fr", "z", "un"), ("fr", "none", None), ("en", "quiet", ""),
             ("it", "alone", "ciao"), ("it", "alone", "ciao"), ("it", "alone", "ciao"), ("xx", "p", "12 34"), ("xx", "q", None)]
    rows += [("en", "s1", "beta " * 5000)] * 3
    want = brute_divergence(rows)
    assert found(spark, rows) == want
    assert {r[:2] for r in want} >= {("", "a"), ("en", "quiet"), ("xx", "q"), ("fr", "")}
    monkeypatch.setattr(divergence, "SHARD_TERMS", 2)
    monkeypatch.setattr(divergence, "TASK_ENTRIES", 5)
    assert found(spark, rows) == want
    assert found(spark, rows, top=2) == [r for r in want if r[2] == "pair" or r[5] <= 2]
    assert found(spark, []) == []


def test_corpus_against_brute_force(spark, corpus):
    rows = [(r["lang"], r["source"], r["text"]) for r in corpus.collect()]
    assert sorted(tuple(r) for r in divergence.source_divergence(corpus).collect()) == brute_divergence(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300), max_size=80), st.sets(st.integers(0, 300), max_size=200))
def test_gallop_finds_the_common_values(a, b):
    a, b = np.array(sorted(a), "int64"), np.array(sorted(b), "int64")
    i, j = divergence.gallop(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_counts_beyond_64_bits_stay_exact(spark):
    n = np.array([0, 5, 10**13, 7 * 10**15], "int64")
    want = [1 + (x + 1) * 10**9 // (10**16 + 17) for x in n.tolist()]
    assert divergence.probabilities(n, 10**16, 17).tolist() == want
    df = spark.createDataFrame([(int(x), 10**16, 17) for x in n], "n long, total long, kept long")
    got = df.select("n", divergence.probability(*map(df.__getitem__, ("n", "total", "kept"))).alias("p")).collect()
    assert dict(map(tuple, got)) == dict(zip(n.tolist(), want))
