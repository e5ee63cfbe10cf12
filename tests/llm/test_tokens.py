"""Token files, packing and the tokenizer behind both: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm import frames, packing
from emberline.llm.tokens import shared_tokenizer, tokenizer_path
from emberline.session import scratch_path

HARD = ["don't I'LL A'S. x'", "É'É ß. İx σΣ. ́a é.", "a<|startoftext|>b <|endoftext|>.", "12.5% ٣٤ \x1cq 日本語。 😀😀. a​.", "...'s 't. ⅷ. ²³ ½! a_b _a.", " \t\n", "", "word, word. WORD!"]


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tool, text, end):
    return np.array(tool.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_word_by_word_ids_equal_whole_text_ids(tool):
    for texts in ([t for t in HARD], *([t] for t in HARD)):
        ids, offsets = shared_tokenizer(tokenizer_path()).texts(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offsets[i]:offsets[i + 1]].tolist() == tool.encode(t, add_special_tokens=False).ids


def test_every_character_before_closing_marks(tool):
    own = shared_tokenizer(tokenizer_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("ka{}.", "a{},. b", "{}!"):
        texts = [shape.format(c) for c in every[::1 if shape == "ka{}." else 7]]
        ids, offsets = own.texts(pa.array(texts))
        for text, a, b, want in zip(texts, offsets[:-1], offsets[1:], tool.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids[a:b].tolist() == want.ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n.,!'éÉ<|>ßKİıi\u0307\u0301\u0958ΣσДЖ%$")), max_size=60))
def test_any_text_has_its_own_ids(text):
    tool = shared_tokenizer(tokenizer_path())
    ids, _ = tool.texts(pa.array([text]))
    assert ids.tolist() == tool.tool.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 99))
def test_segment_round_trip(values, percentile):
    ids = np.array(values, "uint32")
    seg = frames.Segment(frames.pack(ids, np.array([7]), np.array([False]), np.array([len(ids)]), percentile))
    assert np.array_equal(seg.tokens(), ids)
    a, b = len(ids) // 3, len(ids) // 2
    assert np.array_equal(seg.tokens(a, b), ids[a:b])


def test_outliers_do_not_widen_a_block():
    ids = np.arange(128, dtype="uint32") % 8
    ids[5] = 4_000_000_000
    seg = frames.Segment(frames.pack(ids, np.array([1]), np.array([False]), np.array([128])))
    assert seg.width[0] == 3 and len(seg.value) == 1


ROWS = [(5, "One two. Three?"), (2, None), (9, ""), (3, "a b " * 3000), (None, "nobody's text"), (5, "One two. Three?"), (7, "x" * 5000)]


def test_token_files_hold_every_document_in_order(documents, tool):
    got = sorted(frames.token_table(documents(ROWS)).collect(), key=lambda r: r["start"])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = ids_of(tool, text, 1)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_are_read_back_as_ids(spark, documents, tool):
    path = scratch_path(spark, "test-tokens")
    frames.write_tokens(documents(ROWS[:3]), path, tokenizer_path())
    got = {r["doc_id"]: r["ids"] for r in frames.read_tokens(spark, path).collect()}
    assert got[5] == ids_of(tool, "One two. Three?", 1).tolist() and got[2] == [1]


def test_empty_table_gives_no_tokens_and_no_pieces(documents):
    assert frames.token_table(documents([])).collect() == []
    assert packing.pack_documents(documents([])).collect() == []


def check_pieces(rows, pieces, tool, window):
    texts = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        n = 0
        for p in own:
            assert p["offset"] == n and p["length"] > 0
            n += p["length"]
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    placed = sorted((p["sequence_id"], p["offset"], p) for p in pieces)
    stream = [(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for _, _, p in placed]
    at = iter(stream)
    for known, doc_id, text in texts:
        ids, done = ids_of(tool, text, 2), 0
        while done < len(ids):
            d, start, length, crc, total = next(at)
            assert (d, start, total) == (doc_id if known else None, done, len(ids))
            assert crc == zlib.crc32(ids[done:done + length].tobytes())
            done += length
    assert next(at, None) is None
    return padding


def test_pieces_cover_every_document_once_in_order(documents, tool, corpus):
    check_pieces(ROWS, packing.pack_documents(documents(ROWS)).collect(), tool, packing.WINDOW)
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    pieces = packing.pack_documents(corpus).collect()
    assert check_pieces(rows, pieces, tool, packing.WINDOW) < 0.03 * sum(p["length"] for p in pieces)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=9), st.data())
def test_cuts_are_the_cheapest(steps, data):
    window = 16
    pos = np.concatenate([[0], np.cumsum(steps)])
    cost = np.array([0] + [data.draw(st.sampled_from([0, 16, 128])) for _ in steps])
    cost[-1] = 0

    def price(chain):
        total = 0
        for i, j in zip(chain, chain[1:]):
            n = int(pos[j] - pos[i])
            if n > window:
                return None
            total += packing.OPEN_COST + int(cost[j]) + (0 if n & (n - 1) == 0 else window - n)
        return total

    got = price(packing.best_cuts(pos, cost, window))
    best = [0] + [None] * len(steps)
    for j in range(1, len(pos)):
        ways = [best[i] + price([i, j]) for i in range(j) if best[i] is not None and price([i, j]) is not None]
        best[j] = min(ways) if ways else None
    assert got == best[-1]
