"""Near-duplicate vectors against brute force in double precision."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import vectors


def brute_near(rows, threshold=0.9):
    sound = []
    for i, v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        sound.append(np.array(v, "float64") / np.max(np.abs(v)) if ok else None)
    width = max((len(s) for s in sound if s is not None), default=0)
    at = [k for k, s in enumerate(sound) if s is not None]
    m = np.stack([np.pad(sound[k], (0, width - len(sound[k]))) for k in at]) if at else np.zeros((0, 1))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    met = np.zeros((len(rows), len(rows)), dtype=bool)
    met[np.ix_(at, at)] = m @ m.T >= threshold
    np.fill_diagonal(met, False)
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, queue = {k}, [k]
        while queue:
            for j in np.flatnonzero(met[queue.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    queue.append(j)
        seen |= group
        name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], int(met[j].sum()), name, rows[j][0] == name)
    return sorted(out, key=repr)


def found(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], f"vec_id long, embedding array<{kind}>, c int, digest string, n int")
    return sorted((tuple(r) for r in vectors.near_vectors(df, **kw).collect()), key=repr)


def family(rng, n, dims, groups):
    """Lone vectors, and groups around a centre whose members are about as far apart as the threshold."""
    rows = [rng.normal(size=dims) for _ in range(n)]
    for size, noise in groups:
        centre = rng.normal(size=dims)
        rows += [centre + noise * rng.normal(size=dims) for _ in range(size)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


ODD = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0, None]), (5004, [float("nan")] * 3), (5005, [float("inf"), 0.0]), (None, [1.0] * 24), (5006, [1.0] * 24),
       (None, None), (5007, [2.0, 1.0]), (5007, [2.0, 1.0, 0.0]), (5007, [-2.0, 5.0]), (5008, [-0.0, 3.0]), (5009, [0.0, 3.0]), (5010, [1e-38, 0.0, 3e-39])]


def test_links_and_components_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = family(rng, 150, 24, [(40, 0.3), (30, 0.33), (25, 0.05), (20, 0.36)])
    rows += ODD + [(6000 + i, rows[160][1]) for i in range(30)]
    want = brute_near(rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(vectors, "TILE_ROWS", 64)
    monkeypatch.setattr(vectors, "TILE_VALUES", 700)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    assert found(spark, rows) == want
    # Several tables: counts stay right where pairs meet in more than one of them.
    monkeypatch.setattr(vectors, "tables_for", lambda *a: (3, 60))
    assert found(spark, rows, "double") == want


def test_empty_and_extreme(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = [(1, [1e300, 1e299]), (2, [1e-300, 1e-301]), (3, [1e300, -1e299]), (4, [5e-324])]
    assert found(spark, rows, "double") == brute_near(rows)
    with pytest.raises(ValueError):
        vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), threshold=0)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 1500), st.integers(0, 2**32 - 1), st.floats(0.5, 0.99))
def test_bounds_hold_for_any_vectors(dims, seed, threshold):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims)) * rng.choice([1.0, 100.0], size=(6, dims), p=[0.9, 0.1])
    x = np.concatenate([base + s * rng.normal(size=base.shape) * np.abs(base).mean() for s in (0.0, 0.3, 0.6)])
    a, b = vectors.Side(x), vectors.Side(x[::-1] * 3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit @ unit[::-1].T
    got = vectors.links(a, b, threshold)
    clear = np.abs(want - threshold) > 1e-9
    assert (got == (want >= threshold))[clear].all()
    approx = (a.codes @ b.codes.T) * a.scale[:, None] * b.scale[None, :]
    bound = a.error[:, None] * (b.close + b.error) + a.close[:, None] * b.error
    assert (np.abs(approx - want) <= bound + 1e-12).all()


def test_tables_reach_the_recall_they_are_made_for():
    rng = np.random.default_rng(7)
    for n in (10**4, 10**6, 10**9):
        cuts, tables = vectors.tables_for(n, 64, 0.9, 0.99)
        normals = vectors.planes(cuts, tables, 64)
        x = rng.normal(size=(4000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (vectors.buckets(vectors.quantised(vectors.scaled(v)), normals, cuts, tables) for v in (x, y))
        assert (a == b).any(axis=1).mean() >= 0.98
        # The share of all pairs that meet falls, so work grows far slower than the square.
        assert tables / 2 ** cuts <= 120 * n ** -0.5


def test_corpus_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr) == brute_near(rows)


def test_few_links_are_not_looked_at_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 64))
    x[300:330] = x[0] + 0.3 * rng.normal(size=(30, 64))
    side, unit = vectors.Side(x), x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit @ unit.T >= 0.9
    tracemalloc.start()
    got = vectors.links(side, side, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and want.sum() > 600
    # The product and two matrices of one byte an entry; bounds of all pairs in double precision took several times that.
    assert peak < 3.5e6
    monkeypatch.setattr(vectors, "SPARSE", 10**9)
    assert (vectors.links(side, side, 0.9) == want).all()
    # Pairs of an earlier table go either way, entry by entry or table by table.
    left, right = rng.integers(0, 3, (600, 4)), rng.integers(0, 3, (600, 4))
    first = want & (left[:, None, :] != right[None, :, :]).all(axis=2)
    for share in (10**9, 1):
        monkeypatch.setattr(vectors, "SPARSE", share)
        got = want.copy()
        vectors.only_first(got, left, right)
        assert (got == first).all()


def test_every_pair_is_compared_at_any_size(spark, monkeypatch):
    # Dear looks make cuts pay at few vectors, as many vectors do; all cuts stand between the two of each pair.
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(30, 8)), 3)
    base[:, 0] = 0
    rows = []
    for i, v in enumerate(base):
        for side in (-0.1, 0.1):
            rows.append((10 * i + int(side > 0), [side, *v[1:].tolist()]))
    monkeypatch.setattr(vectors, "LOOK", 1.0)
    monkeypatch.setattr(vectors, "planes", lambda cuts, tables, dims: np.tile(np.eye(1, dims), (tables * cuts, 1)))
    assert vectors.tables_for(len(rows), 8, 0.9, 0.999)[0] > 0
    want = brute_near(rows)
    assert sum(w[1] for w in want) >= 50
    assert found(spark, rows, "double") == want


def test_parts_of_tiles_in_passes_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = family(rng, 260, 16, [(150, 0.25), (30, 0.33), (12, 0.05)]) + ODD
    tables = []
    monkeypatch.setattr(vectors, "hold", lambda df, name, hold=vectors.hold: tables.append(name) or hold(df, name))
    monkeypatch.setattr(vectors, "TILE_ROWS", 64)
    monkeypatch.setattr(vectors, "PARTS", 2)
    monkeypatch.setattr(vectors, "LEAST_MOVED", 1)
    assert vectors.part_rows(16) == 512
    assert found(spark, rows, "double") == brute_near(rows)
    assert tables.count("vector-links") > 1
