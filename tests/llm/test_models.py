"""Toxicity, quality and page extraction: held-out accuracy, restoration, and every defined edge."""

import html
import random
import re
import zlib

import numpy as np
import pytest

from emberline.llm import extraction, labelled, quality, toxicity
from emberline.llm.html_pages import labelled_pages

SF = "/root/testdata/sf0.01"


def fold_of(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def rank_auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("scores, label, folds, held", [(toxicity.toxicity_scores, "toxic", 5, 0), (quality.quality_scores, "quality", 3, 1)])
def test_held_out_accuracy(spark, scores, label, folds, held):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in scores(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r["held_out"] == (fold_of(r["doc_id"], folds) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    own = [(got[r["doc_id"]]["score"], r[label]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    s, y = np.array(own).T
    assert rank_auc(s, y) > 0.97 and ((s >= 0.5) == y).mean() > 0.97


@pytest.mark.parametrize("scores, label, folds, held", [(toxicity.toxicity_scores, "toxic", 5, 0), (quality.quality_scores, "quality", 3, 1)])
def test_held_out_labels_do_not_teach(spark, documents, scores, label, folds, held):
    texts = ["an awful idiot wrote this piece", "a fine calm piece of writing", None, ""] * 10
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, texts[7])])
    schema = f"doc_id long, {label} int"
    rows = [(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (3, None)]
    flipped = [(i, 1 - v if i is not None and v is not None and fold_of(i, folds) == held else v) for i, v in rows]
    first, second = (sorted(map(str, scores(docs, spark.createDataFrame(r, schema)).collect())) for r in (rows, flipped))
    assert first == second and len(first) == 42
    none = scores(docs, spark.createDataFrame([], schema)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}
    assert scores(documents([]), spark.createDataFrame(rows, schema)).collect() == []


@pytest.fixture(scope="module")
def chars(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return toxicity.CharModel(toxicity.char_counts(docs))


def test_counts_are_of_all_words(documents):
    counts = toxicity.char_counts(documents([(1, "ab ab, ÄB"), (2, None), (3, "ab")])).reshape((toxicity.SYMBOLS,) * 3)
    a, b, ae = (toxicity.INDEX[c] for c in "abä")
    assert counts[0, 0, a] == 3 and counts[0, a, b] == 3 and counts[a, b, 0] == 3 and counts[0, 0, ae] == 1 and counts.sum() == 12


@pytest.mark.parametrize("written, meant", [
    ("1d1ot", "idiot"), ("m0r0n", "moron"), ("p@thetic", "pathetic"), ("idiooooot", "idiot"), ("tr4sh", "trash"), ("i.d.i.o.t", "idiot"),
    ("s-c-u-m", "scum"), ("lo5er", "loser"), ("clooown", "clown"), ("idiot", "idiot"), ("", ""), ("###", "")])
def test_disguised_words_are_restored(chars, written, meant):
    assert chars.restore(written) == meant


def test_decoding_is_the_best_of_all_readings(chars):
    """Against full enumeration, where every sign is one of its letters."""
    for written in ("m0r0n", "1d1ot"):
        readings = [""]
        for ch in written:
            readings = [r + c for r in readings for c in (ch if ch in toxicity.INDEX else toxicity.LOOKS_LIKE[ch])]

        def price(word):
            symbols = [0, 0, *(toxicity.INDEX[c] for c in word), 0]
            return sum(chars.cost[a][b][c] for a, b, c in zip(symbols, symbols[1:], symbols[2:]))

        assert chars.restore(written) == min(readings, key=price)


def test_disguise_does_not_hide_toxic_words(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    clean = "Of the and thing that was here with this only"
    rows = [(10_000_001, f"{clean} 1d1ot {clean} w0rthless scuuuum"), (10_000_002, f"{clean} i d i o t {clean} p-a-t-h-e-t-i-c m0r0n"), (10_000_003, f"{clean} {clean}")]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs.union(extra), labels).filter("doc_id > 10000000").collect()}
    assert got[10_000_001] > 0.5 and got[10_000_002] > 0.5 and got[10_000_003] < 0.5


def test_signs_for_letters_are_read_in_words_and_in_spaced_runs(spark, documents):
    rng = random.Random(4)
    calm = "of the and thing that was here with this only some other quiet morning river walks under tall trees".split()
    rude = ["loser", "idiot", "asshole", "ass", "bastard", "scum"]
    some = lambda: [rng.choice(calm) for _ in range(rng.randint(6, 18))]
    taught = [(i, " ".join(some() + ([rude[i // 2 % 6]] if i % 2 else []) + some())) for i in range(1200)]
    hidden = ["l053r", "1d10t", "4$$h0l3", "a55", "a$$", "$ c u m", "b @ s t a r d", "a s s", "a. $. s.", "! d ! 0 t"]
    planted = [(5000 + i, " ".join([*some(), h, *some()])) for i, h in enumerate([*hidden, "here", "w@lks", "r ! v e r"])]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in taught], "doc_id long, toxic int")
    scores = toxicity.toxicity_scores(documents(taught + planted), labels).filter("doc_id >= 5000").collect()
    got = {r["doc_id"] - 5000: r["score"] for r in scores}
    assert {h for i, h in enumerate(hidden) if got[i] <= 0.5} == set() and max(got[len(hidden) + k] for k in range(3)) < 0.5


def test_logistic_fit_matches_the_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] + 0.5)))).astype(float)
    model = labelled.fit_logistic(x, y)
    z = np.column_stack([np.ones(500), (x - model["mean"]) / model["scale"]])
    assert np.abs(z.T @ (y - labelled.probability(model, x)) - np.array([1e-6, 1e-2, 1e-2, 1e-2]) * model["w"]).max() < 1e-3


@pytest.fixture(scope="module")
def model():
    return extraction.trained()


def test_marginals_against_enumeration(model):
    page = "<body><nav><a>x</a></nav><article><p>some words of text here</p></article></body>"
    nodes, _ = extraction.parse(page)
    got = model.marginals(nodes)
    want, total = np.zeros((len(nodes), 3)), 0.0
    for code in range(3 ** len(nodes)):
        ys = [code // 3 ** i % 3 for i in range(len(nodes))]
        weight = sum(model.local(n)[y] for n, y in zip(nodes, ys, strict=True)) + model.prior[ys[0]]
        weight += sum(model.edge[ys[n.parent]][y] for n, y in zip(nodes[1:], ys[1:], strict=True))
        p = np.exp(weight)
        total += p
        for i, y in enumerate(ys):
            want[i, y] += p
    assert np.allclose(got, want / total, atol=1e-6)


def test_held_out_pages(model):
    wrong = 0
    for page in labelled_pages(100, seed=99):
        nodes, runs = extraction.parse(page)
        ys = []
        for n in nodes:
            ys.append(n.y or (ys[n.parent] if n.parent >= 0 else "m"))
        wrong += model.extract(page) != " ".join(r for b, r in runs if ys[b] == "c")
    assert wrong <= 5


def test_table_pages_give_their_article(spark, model):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in extraction.main_text(spark.read.parquet(f"{SF}/pages.parquet"), model).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_broken_and_odd_pages(spark, model):
    long = "<p>" + "word " * 60_000 + "</p>"
    pages = {
        1: None, 2: "", 3: "<p>", 4: "no markup at all", 5: "<html><body><article><h1>A &amp; B</h1><p>x&nbsp;y<b>z</b><p>second\n\n line<br>third",
        6: f"<body><nav><a href=x>menu</a></nav><article>{long}</article></body>", 7: "</div></p><!-- <p>no</p>",
        8: "<article><p>kept words of text</p><script>var a='<p>not</p>';</script><div class='comments'><p>reader says</p></div></article>",
        9: "<body><div class='cookie notice'><p>we use cookies</p></div><main><p>the real text of this page is here</p></main><form><input value=q><p>search</p></form></body>",
        10: "<" * 500, 11: "<a " * 300}
    df = spark.createDataFrame([(k, f"u{k}", v, "clash", 1) for k, v in pages.items()], "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: r["text"] for r in extraction.main_text(df.union(df.filter("page_id = 5")), model).collect()}
    assert got[1] == got[2] == got[3] == ""
    assert got[5] == "A & B x yz second line third" and got[6] == "word " * 59_999 + "word" and got[7] == ""
    assert got[8] == "kept words of text" and got[9] == "the real text of this page is here"
    assert extraction.main_text(df.limit(0), model).collect() == []


def test_parser_never_fails(model):
    draw = random.Random(1)
    pieces = ["<p>", "</p>", "<div class='a'>", "</div>", "<td>", "<table>", "</table>", "<b>", "</b>", "x", "&amp;", "<!--", "-->", "<script>", "</script>", "<", ">", "'", '"', "<li>", "<br/>"]
    for _ in range(300):
        page = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 40)))
        nodes, runs = extraction.parse(page)
        assert all(n.parent < i for i, n in enumerate(nodes)) and all(0 <= b < len(nodes) for b, _ in runs)
        model.extract(page)


def test_pages_of_bare_paragraphs_keep_them_all(model):
    for head, tail in (("", ""), ("<h1>Of words</h1>", ""), ("<nav><ul><li><a href='/'>home page</a></li></ul></nav>", "<footer>copyright someone</footer>")):
        for count in (1, 3, 12):
            for size in (6, 16, 40, 120):
                paragraphs = [" ".join(f"word{k}x{i}"[:3 + (k + i) % 6] for i in range(size)) for k in range(count)]
                got = model.extract("<html><body>" + head + "".join(f"<p>{p}</p>" for p in paragraphs) + tail + "</body></html>")
                assert got == " ".join(["Of words"] * ("h1" in head) + paragraphs)
