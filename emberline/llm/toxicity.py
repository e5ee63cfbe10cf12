"""Toxicity of texts behind disguises: noisy-channel restoration, then word evidence.

Words that may be disguised (signs or digits beside letters or each other, drawn-out letters, letters and signs spaced
apart) are read as a lattice: each written character may stand for itself, for a letter it resembles, for a repeat or
for a mere separator.  Viterbi decoding under a character trigram model of the whole corpus picks the likeliest word.
Written and restored words then give evidence, learned from labelled rows, and the strongest evidence of a document
becomes a calibrated probability.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.batches import slices, split_words, worker_cache
from emberline.llm.labelled import dense_sums, first_drawn, fit_logistic, fold, probability, sampled_rows, training_labels
from emberline.session import hold

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that teach at most, and the parts in which they are calibrated on what the others teach.
SAMPLE_DOCS, PARTS = 30_000, 3
BUCKETS = 1 << 18
#: Pseudo-documents at the base rate behind every piece of evidence.
PRIOR_DOCS = 2.0
PREFIXES = (4, 5, 6)
#: Evidence below this says nothing by itself.
FAINT, STRONG = 0.7, 2.0
REMEMBERED = 100_000

# Letters of the character model: its first symbol is the word boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
SYMBOLS = len(LETTERS) + 1
# What a written sign may stand for; fixed values.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'`^,:;/\\#%&=?"
REPEAT_COST, DOUBLE_COST, SEPARATE_COST, DROP_COST, CONFUSE_COST, SPLIT_COST, STRANGE_COST = 1.0, 6.0, 1.5, 10.0, 1.0, 6.0, 14.0
N_FEATURES = 20
MARKS = ".,;:!?\"'()[]{}<>#*%$&|~`^_-=+/\\@"
_LOOKS, _MARKED = (f"[{inner}{re.escape(''.join(LOOKS_LIKE))}]" for inner in ("", r"\pL" + re.escape(SEPARATORS)))
#: A sign that may be a letter beside a letter or another sign, anything between letters, or drawn-out letters.
DISGUISED = "|".join([r"\pL[^\pL\s]+\pL", _LOOKS + _MARKED, _MARKED + _LOOKS, *(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")])
#: Marks around a single letter or sign that cannot be letters themselves.
AROUND = "".join(c for c in MARKS if c not in LOOKS_LIKE)


class CharModel:
    """Trigram log-probabilities over ``LETTERS``, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype("float64")
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 10 * p2) / (c3.sum(axis=2, keepdims=True) + 10)
        self.cost = (-np.log(p3)).tolist()

    def restore(self, written: str, spaced: bool = False) -> str:
        """The likeliest reading of a written word; blanks in it where ``spaced`` letters hold several words."""
        # State: the last two symbols read, so that each is reached by its cheapest path only.
        # Readings are linked letters, so that a long word costs no more per letter than a short one.
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        drawn = {k for m in re.finditer(r"(.)\1\1+", written) for k in range(*m.span())}
        for at, ch in enumerate(written):
            repeat = REPEAT_COST if at in drawn else DOUBLE_COST
            options = [(ch, 0.0)] if ch in INDEX else [(c, CONFUSE_COST) for c in LOOKS_LIKE.get(ch, "")]
            new: dict[tuple[int, int], tuple[float, tuple]] = {}

            def offer(state: tuple[int, int], cost: float, text: tuple, new=new) -> None:
                if state not in new or cost < new[state][0]:
                    new[state] = (cost, text)

            for (a, b), (cost, text) in paths.items():
                for c, extra in options:
                    i = INDEX[c]
                    if i == b:
                        offer((a, b), cost + repeat + extra, text)
                    offer((b, i), cost + extra + self.cost[a][b][i], (text, c))
                    if spaced and b:
                        end = cost + self.cost[a][b][0] + SPLIT_COST
                        offer((0, i), end + extra + self.cost[0][0][i], (text, " " + c))
                if ch in SEPARATORS or ch in LOOKS_LIKE:
                    offer((a, b), cost + (DROP_COST if ch in LOOKS_LIKE else SEPARATE_COST), text)
                elif not options:
                    offer((a, b), cost + STRANGE_COST, text)
            paths = new
        ends = [(cost + self.cost[a][b][0], text) for (a, b), (cost, text) in paths.items()]
        least = min(cost for cost, _ in ends)
        return min(_spelled(text) for cost, text in ends if cost == least)


def _spelled(text: tuple) -> str:
    out = []
    while text:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


class Model(NamedTuple):
    """What scoring needs: bounded by the alphabet and the number of buckets, whatever the corpus."""

    chars: np.ndarray
    evidence: np.ndarray
    calibration: dict[str, np.ndarray]


def plain(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)


def buckets(words: pa.Array) -> np.ndarray:
    """Evidence buckets of each word, a row for each: the word itself and its beginnings."""
    forms = [words] + [pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), pa.scalar("~"), "") for n in PREFIXES]
    return np.column_stack([
        pd.util.hash_array(f.to_numpy(zero_copy_only=False).astype(object), categorize=False) % BUCKETS for f in forms]).astype("int64")


def readings(texts: pa.Array, chars: CharModel, memo: dict[str, str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Documents and codes of all words and restored words, and the distinct ones."""
    codes, offsets, raw = split_words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    words = plain(raw)
    extra: dict[str, int] = {}
    docs, found = [doc], [codes]

    def read(written: str, spaced: bool) -> str:
        key = f" {written}" if spaced else written
        if key not in memo:
            if len(memo) > REMEMBERED:
                memo.clear()
            memo[key] = chars.restore(written, spaced)
        return memo[key]

    odd = np.flatnonzero(pc.match_substring_regex(pc.utf8_lower(raw), DISGUISED).to_numpy(zero_copy_only=False))
    if len(odd):
        replaced = np.full(len(words), -1, dtype="int64")
        for i in odd.tolist():
            r = read(raw[i].as_py().lower(), False)
            if r and r != words[i].as_py():
                replaced[i] = extra.setdefault(r, len(extra))
        at = np.flatnonzero(replaced[codes] >= 0)
        docs.append(doc[at])
        found.append(len(words) + replaced[codes[at]])
    # Spaced-out letters and signs: single as written, within marks that are no letters, or within any marks.
    single = pc.utf8_lower(raw)
    for narrower in (pc.utf8_trim(single, characters=AROUND), words):
        single = pc.if_else(pc.equal(pc.utf8_length(single), 1), single, narrower)
    one = (pc.utf8_length(single).to_numpy(zero_copy_only=False) == 1)[codes]
    if one.any():
        edge = np.diff(np.concatenate([[0], one.view("int8"), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            for d in range(doc[a], doc[b - 1] + 1):
                lo, hi = max(a, int(offsets[d])), min(b, int(offsets[d + 1]))
                if hi - lo >= 3:
                    for r in read("".join(single[int(c)].as_py() for c in codes[lo:hi]), True).split():
                        docs.append(np.array([d]))
                        found.append(np.array([len(words) + extra.setdefault(r, len(extra))]))
    return np.concatenate(docs), np.concatenate(found), pa.concat_arrays([words, pa.array(list(extra), pa.string())])


def features(texts: pa.Array, chars: CharModel, evidence: np.ndarray, memo: dict[str, str]) -> np.ndarray:
    """The three strongest pieces of evidence of each document, how many are strong, and its length."""
    doc, codes, words = readings(texts, chars, memo)
    full = pc.utf8_length(words).to_numpy(zero_copy_only=False) > 1
    weight = np.where(full, evidence[buckets(words)].max(axis=1), 0.0) if len(words) else np.zeros(0)
    n = np.bincount(doc, minlength=len(texts))
    at = np.flatnonzero(weight[codes] > FAINT)
    pairs = np.unique(doc[at] * np.int64(len(words)) + codes[at]) if len(at) else np.zeros(0, "int64")
    d, w = pairs // max(len(words), 1), weight[pairs % max(len(words), 1)]
    order = np.lexsort((-w, d))
    d, w = d[order], w[order]
    place = np.arange(len(d)) - np.searchsorted(d, d)
    out = np.zeros((len(texts), 5))
    for k in range(3):
        out[d[place == k], k] = w[place == k]
    out[:, 3] = np.log1p(np.bincount(d[w > STRONG], minlength=len(texts)))
    out[:, 4] = np.log1p(n)
    i, j = np.triu_indices(5)
    return np.hstack([out, out[:, i] * out[:, j]])


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all words of all documents, added up in Spark: one row for each trigram that occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, dtype="int64")
        to = np.zeros(0x110000, dtype="uint8")
        for c, i in INDEX.items():
            to[ord(c)] = i
        for batch in batches:
            for part in slices(batch):
                codes, _, raw = split_words(part.column("text"))
                times = np.bincount(codes, minlength=len(raw))
                words = pc.binary_join_element_wise(pa.scalar("\0\0"), plain(raw), pa.scalar("\0"), "")
                size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype("int64")
                symbols = to[np.frombuffer("".join(words.to_numpy(zero_copy_only=False)).encode("utf-32-le", "surrogatepass"), "<u4")].astype("int64")
                ends = np.cumsum(size)
                owner = np.repeat(np.arange(len(size)), size)
                inner = np.ones(len(symbols), dtype=bool)
                inner[ends - size] = inner[ends - size + 1] = False
                at = np.flatnonzero(inner)
                gram = (symbols[at - 2] * SYMBOLS + symbols[at - 1]) * SYMBOLS + symbols[at]
                total += np.bincount(gram, weights=times[owner[at]], minlength=SYMBOLS ** 3).astype("int64")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    return dense_sums(docs.select("text").mapInArrow(run, "gram long, n long"), "gram", ["n"], SYMBOLS ** 3)[0]


def _memo(key: str) -> dict[str, str]:
    cache = worker_cache()
    return cache.setdefault(key, {})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Character model of all documents; evidence and calibration from a bounded sample of labelled rows.

    The calibration sees each part of the sample with the evidence of the others, so that both use all of it.
    """
    sc = docs.sparkSession.sparkContext
    counts = char_counts(docs)
    key = hashlib.sha256(counts.tobytes()).hexdigest()
    shipped = sc.broadcast(counts)  # SYMBOLS cubed numbers
    drawn = first_drawn(training_labels(labels, "toxic", FOLDS, HELD_OUT), SAMPLE_DOCS)
    text = F.xxhash64("text")
    # Equal texts teach once and fall in one part.
    sample = hold(sampled_rows(docs, drawn).withColumns(
        {"h": text, "part": F.pmod(text, F.lit(PARTS)).cast("int")}).dropDuplicates(["h", "y"]).select("text", "y", "part"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = CharModel(shipped.value)
        seen = np.zeros((PARTS, 2, BUCKETS + 1), dtype="int64")
        for batch in batches:
            for p in slices(batch):
                y, part = (p.column(c).to_numpy(zero_copy_only=False) for c in ("y", "part"))
                doc, codes, words = readings(p.column("text"), chars, _memo(key))
                b = buckets(words) if len(words) else np.zeros((0, 1 + len(PREFIXES)), "int64")
                pairs = np.unique((doc[:, None] * np.int64(BUCKETS) + b[codes]).ravel())
                for k in range(PARTS):
                    for c in (0, 1):
                        own = (y == c) & (part == k)
                        seen[k, c, :BUCKETS] += np.bincount(pairs[own[pairs // BUCKETS]] % BUCKETS, minlength=BUCKETS)
                        seen[k, c, BUCKETS] += int(own.sum())
        k, at = np.nonzero(seen.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k * (BUCKETS + 1) + at), pa.array(seen[k, 0, at]), pa.array(seen[k, 1, at])], ["key", "n0", "n1"])

    counted = sample.select("text", "y", "part").mapInArrow(count, "key long, n0 long, n1 long")
    seen = dense_sums(counted, "key", ["n0", "n1"], PARTS * (BUCKETS + 1)).reshape(2, PARTS, BUCKETS + 1).swapaxes(0, 1)
    model = Model(counts, _evidence(seen.sum(axis=0)), {})
    x, y = [], []
    for k in range(PARTS):
        others = model._replace(evidence=_evidence(seen.sum(axis=0) - seen[k]))
        for r in _applied(sample.filter(F.col("part") == k), others, ["y"], "y double, x binary").collect():
            x.append(np.frombuffer(r["x"]))
            y.append(r["y"])
    if not y:
        x, y = [np.zeros(N_FEATURES)], [0.5]
    return model._replace(calibration=fit_logistic(np.array(x), np.array(y), ridge=1.0))


def _evidence(seen: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket over the base rate, drawn towards it where little was seen."""
    n0, n1 = seen
    base = (n1[-1] + 0.5) / (n0[-1] + n1[-1] + 1)
    rate = (n1 + PRIOR_DOCS * base) / (n0 + n1 + PRIOR_DOCS)
    return (np.log(rate / (1 - rate)) - math.log(base / (1 - base)))[:BUCKETS].astype("float32")


def _applied(rows: DataFrame, model: Model, keep: list[str], schema: str) -> DataFrame:
    """Features (without a calibration) or score and prediction beside the columns to keep."""
    shipped = rows.sparkSession.sparkContext.broadcast(tuple(model))
    key = hashlib.sha256(model.chars.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        chars = CharModel(m.chars)
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"), chars, m.evidence, _memo(key))
                cols = [part.column(c) for c in keep]
                if not m.calibration:
                    cols.append(pa.array([row.tobytes() for row in x], pa.binary()))
                else:
                    p = probability(m.calibration, x)
                    cols += [pa.array(p), pa.array((p >= 0.5).astype("int32"))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text counts as empty; equal texts have equal scores; without labelled rows every score is 0.5.  A null
    doc_id is held out as false.  Documents stream through twice, for the character counts and for the scores.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return _applied(rows, model, ["doc_id", "held_out"], "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = train(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))
    key = hashlib.sha256(model.chars.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        chars = CharModel(m.chars)
        for batch in batches:
            for part in slices(batch):
                p = probability(m.calibration, features(part.column("text"), chars, m.evidence, _memo(key)))
                yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
