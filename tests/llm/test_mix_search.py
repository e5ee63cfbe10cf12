"""Mixing and search against brute force; the whole pipeline stage by stage."""

import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import catalog, mixing, topk, toxicity
from emberline.llm.frames import END_ID


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=8), st.integers(0, 60))
def test_highest_quotients_one_by_one(parties, seats):
    votes, most = (np.array(x) for x in zip(*parties, strict=True))
    won = np.zeros(len(votes), int)
    for _ in range(seats):
        quotient = np.where((won < most) & (votes > 0), votes / (2 * won + 1), -1)
        if quotient.max() < 0:
            break
        won[quotient.argmax()] += 1
    assert mixing.highest_quotients(votes, seats, most).tolist() == won.tolist()


def test_targets_share_the_excess_by_weight():
    sizes = np.array([100.0, 10, 10, 880])
    got = mixing.targets(sizes, np.array([1.0, 2, 3, 1]), 1000.0, 3 * sizes)
    assert got.tolist() == [300, 30, 30, 640]
    assert mixing.rank_weights([None, "b", "a", "é", "z"]).tolist() == [2, 2, 1, 1, 3]


def test_mix_follows_the_contract(documents):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), f"s{i % 7}") for i in range(600)]
    rows += [(1000 + i, None if i % 2 else "", "s1") for i in range(6)] + [(2000, "a b c", None), (5, "x y", "s5"), (None, "p q r", "s2"), (3000, "", "empty")]
    df = documents(rows)
    df = df.withColumn("source", df["source"])
    got = mixing.mixed(df).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    again = mixing.mixed(df.repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(x["n"] * x["times"] for x in r["runs"])
    for own in by.values():
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(8, 0.02 * own[0]["target"])
    assert mixing.mixed(documents([])).collect() == []


def test_rows_of_one_id_or_of_none_get_their_own_runs(documents):
    rows = [(None if i % 3 else i // 30, " ".join(f"r{i}w{k}" for k in range(5 + 7 * i)), f"s{i % 4}") for i in range(90)]
    df = documents(rows)
    want = {(r["source"], r["size"]): r["taken"] for r in mixing.mixed(df).collect()}
    found, by = defaultdict(int), defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        words = r["text"].split()
        (i,) = {int(w[1:w.index("w")]) for w in words}
        found[r["source"], 5 + 7 * i] += len(words)
        by[r["source"]] += len(words)
    assert len(want) == len(rows) and dict(found) == {k: v for k, v in want.items() if v}
    assert all(by[r["source"]] == pytest.approx(r["target"], rel=0.02) for r in mixing.mixed(df).collect())


def test_small_sources_come_near_their_targets(documents):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(3000, 9000))), "big") for i in range(40)]
    rows += [(1000 + i, " ".join(["w"] * int(rng.integers(1, 40))), f"host{i % 150}") for i in range(450)]
    got = mixing.mixed(documents(rows)).collect()
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, taken[s], t)
    assert mixing.highest_quotients(np.ones(30_000), 30_000_000, np.full(30_000, 5000)).tolist() == [1000] * 30_000


def test_rows_without_an_id_are_dealt_over_shards(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    seen = []
    real = mixing.hold
    monkeypatch.setattr(mixing, "hold", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rows = [(None, "a b c d", "s")] * 300
    assert len(mixing.mixed(documents(rows)).collect()) == 300
    placed = dict(seen)["mix-placed"]
    assert placed.groupBy("shard").count().agg({"count": "max"}).first()[0] < 40


def test_layers_are_copies_and_parts():
    text = " one  two three\nfour "
    assert mixing.layers(text, [(0, 4, 1)]) == [text]
    assert mixing.layers(text, [(0, 2, 3), (2, 2, 1)]) == [text, "one  two", "one  two"]
    assert mixing.layers(text, [(0, 1, 1), (2, 1, 1)]) == ["one\nthree"] and mixing.layers(text, []) == []


def brute_top(rows, k=5):
    sound = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in dict((i, v) for i, v in sound if i % 50 == 0).items():
        best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=17)]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None]), (350, [float("nan")] * 17), (303, [float("inf")] + [0.0] * 16), (304, []), (305, [0.5, 0.25]),
             (None, [1.0] * 17), (400, [0.0] * 17)] + [(500 + i, rows[50][1]) for i in range(20)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, shard string")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 23)
    for values, block in ((1 << 20, 4096), (64 * 17, 3), (64 * 17, 4096)):
        monkeypatch.setattr(topk, "SHARD_VALUES", values)
        monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
        got = sorted(tuple(r) for r in topk.top_k(df).collect())
        assert got == brute_top(rows)
    assert topk.top_k(df.limit(0)).collect() == []
    empty = spark.createDataFrame([(0, []), (7, []), (9, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(empty).collect()) == [(0, 1, 7, 0), (0, 2, 9, 0)]
    big = [(i, [float(x) for x in rng.normal(size=9) * 1e6]) for i in range(200)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    want = [(q, n, i, s) for q, n, i, s in brute_top([(i, [np.float32(x) for x in v]) for i, v in big])]
    assert sorted(tuple(r) for r in topk.top_k(df.withColumn("embedding", df["embedding"].cast("array<float>"))).collect()) == want
    few = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (7, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(few).collect()) == brute_top([(0, [1.0]), (50, [2.0]), (7, [-1.0])])


def test_non_essential_terms_cannot_reach_the_bar_alone():
    rng = np.random.default_rng(3)
    rows = rng.integers(-90, 90, (4000, 64)).astype("float64")
    rows[77] = np.rint(rows[5] * 0.9)
    low, high = rows.min(axis=0), rows.max(axis=0)
    sizes = []
    for q in (5, 9, 11):
        scores = rows @ rows[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(4000), -scores))[:5]
        spread = np.maximum(rows[q] * low, rows[q] * high) - np.minimum(rows[q] * low, rows[q] * high)
        bottom = np.minimum(rows[q] * low, rows[q] * high).sum()
        for bar in (-np.inf, scores[want[-1]]):
            essential, others = topk.essential_terms(spread, np.argsort(spread, kind="stable"), bar - bottom)
            assert bottom + spread[others].sum() < bar or not len(others)
            assert sorted([*essential, *others]) == list(range(64))
            sizes.append(len(essential))
            at, score = topk.best_of_shard(rows[q], rows, low, high, np.arange(4000), q, 5, bar)
            assert at.tolist() == want.tolist() and score.tolist() == scores[want].tolist()
    assert sizes[0] == 64 and max(sizes[1::2]) < 64


def test_scores_that_overflow_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(OverflowError):
        topk.top_k(df)


def test_every_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in catalog.LLM_QUERIES}
    assert numbers == set(range(1, 14)) and END_ID == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    raw = docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == raw.columns
    texts = {n: {r["doc_id"]: r["text"] for r in t.collect()} for n, t in tables.items() if n != "packing"}
    full = {r["doc_id"]: r["text"] for r in raw.collect()}
    scores = toxicity.toxicity_scores(raw, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert texts["toxicity"] == {r["doc_id"]: full[r["doc_id"]] for r in scores if not r["predicted"]}
    from test_dedup import brute_components, brute_repeats

    names = brute_components(sorted(texts["toxicity"].items()), *cp.NEAR)
    assert texts["near_duplicates"] == {d: t for d, t in texts["toxicity"].items() if names[d][1] == d}
    want = brute_repeats(sorted(texts["near_duplicates"].items()))
    for d, t in texts["repeats"].items():
        assert 0 <= want[d][0] - want[d][1] - len(t.encode()) <= 6 * want[d][2]
    words = lambda t: len(re.findall(mixing.WORD, t))
    size = {d: words(t) for d, t in texts["repeats"].items()}
    taken = defaultdict(int)
    for r in tables["mixing"].collect():
        taken[r["doc_id"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 3 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) <= 0.02 * sum(size.values())
    copies = tables["mixing"].count()
    assert tables["packing"].filter("start = 0").count() == copies
