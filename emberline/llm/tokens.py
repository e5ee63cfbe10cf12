"""Exact token ids of a public tokenizer, with its work on repeated words remembered."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from emberline.llm.batches import slices, split_words, worker_cache

#: Distinct words whose ids a Python worker remembers; beyond, it starts anew.
REMEMBERED = 300_000
#: Small letters of ASCII and Latin-1: a word of these alone is one piece for the merges.
PLAIN = "".join(c for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)]) if c.isalpha())


def steady_class(below: int = 0x600) -> str:
    """A pattern's class of the letters and digits that stay one letter or digit when composed and made small.

    Some others become a letter and a mark (U+0130, U+0958), and marks behind them would join that one.
    """
    def steady(c: str) -> bool:
        small = unicodedata.normalize("NFC", c).lower()
        return unicodedata.category(c)[0] in "LN" and len(small) == 1 and unicodedata.category(small)[0] in "LN"

    codes = {k for k in range(below) if steady(chr(k))}
    first, last = (sorted(k for k in codes if k + step not in codes) for step in (-1, 1))
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True)) + "]"


#: Such a letter or digit, then marks that never join it in one piece, then the word's end.
CLOSED = rf"({steady_class()})([.,!?;:*%$#&|]+)(\s|$)"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, word by word.

    This vocabulary drops white space, ignores case and never merges across white space, nor between a steady letter
    or digit and the marks after it.  So a text's ids are the ids of its words and closing marks in a row, and each
    distinct one needs the library once.  Texts that could hold a special token's name are left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tool = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {ord(c): level.pre_tokenize_str(c)[0][0] for c in PLAIN if not c.isascii()}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype="uint32")
        self.starts = np.zeros(1, dtype="int64")

    def word(self, w: str) -> list[int]:
        small = w.lower()
        if not small.strip(PLAIN):
            return [t.id for t in self.tool.model.tokenize(small.translate(self.visible))]
        return self.tool.encode(w, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        ids = [self.word(w) for w in words]
        at = self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), "int64", len(ids)))
        while at[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.starts[-1]:at[-1]] = np.fromiter((i for x in ids for i in x), "uint32", at[-1] - self.starts[-1])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, at])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and each text's offsets."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), CLOSED, r"\1 \2\3")
        codes, offsets, words = split_words(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        words = words.to_numpy(zero_copy_only=False)
        at = np.fromiter((self.known.get(w, -1) for w in words), "int64", len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([words[i] for i in new])
        at = at[codes]
        first = self.starts[at]
        n = self.starts[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends[offsets]


def shared_tokenizer(path: str) -> WordTokenizer:
    cache = worker_cache()
    if path not in cache:
        cache[path] = WordTokenizer(path)
    return cache[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Bounded slices of ``text`` with their ids and offsets; ``end_id`` follows every document."""
    tool = shared_tokenizer(path)
    for batch in batches:
        for part in slices(batch):
            ids, offsets = tool.texts(part.column("text"))
            n = part.num_rows
            out = np.empty(len(ids) + n, dtype="uint32")
            out[offsets[1:] + np.arange(n)] = end_id
            mask = np.ones(len(out), dtype=bool)
            mask[offsets[1:] + np.arange(n)] = False
            out[mask] = ids
            yield part, out, offsets + np.arange(n + 1)
