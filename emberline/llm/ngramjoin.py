"""Exact Jaccard join on word n-grams: size-aware, with small sets by subsets and large sets by inverted lists.

Two sets link when 100 |A n B| >= NUMERATOR |A u B|, so their sizes are close and they differ in few members.

* A small set is entered under every subset of the sizes that a partner must share with it.
* A large set is entered under parts: the universe is dealt into more parts than partners of its size class can differ
  in, so partners agree on whole parts, and those that agree on an empty one only are entered under it, too.
* The size where one gives way to the other is where the entries of the first begin to cost more.

Sets that meet in a list are candidates.  A list is read once, with a parity sketch of each of its sets: the sketches
of two sets differ in no more bits than the sets in members, so pairs that differ too much are told apart for certain.
What is left of a list is a spanning forest of those that may link; a very long list, as large groups of copies make
it, is taken as belonging together without that.  The connected groups of all lists hold every link.  Inside a group
sets are compared exactly, many at a time, and each comparison again yields a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.batches import mix, shingle_hashes, slices, split_words, word_hashes
from emberline.llm.repeats import release
from emberline.operators.components import min_label
from emberline.session import hold, let_go

#: Words of a shingle, and how many hundredths of their union two sets share to link, unless a call says otherwise.
SHINGLE_WORDS, NUMERATOR = 4, 85
#: Sets and members compared in one go.
BLOCK_SETS, BLOCK_MEMBERS = 256, 200_000
#: Growth of the size classes.
CLASS_RATIO = 1.3
#: What it costs, in entries, when a set is entered under empty parts, which say little.
CROWDED_COST = 1000.0
#: Members of a list, in a slice and in all, beyond which it is taken as belonging together.
LONG_IN_SLICE, LONG_LIST = 64, 512
#: Bytes of entries, and of entries with their sketches, that are moved at once for each member of all sets, and in any case.
ENTRIES_MOVED, SKETCHED_MOVED, LEAST_MOVED = 4, 8, 1 << 26
#: Bytes of an entry, and of one with its sketch besides the sketch.
ENTRY_BYTES, SKETCHED_BYTES = 16, 32
#: Stands for a null doc_id in keys.
NAMELESS = -(1 << 63)
FACTS = "doc long, h long, n long, set_id binary, s long, sketch binary, keys array<long>, wide array<long>, near array<long>"


def least_partner(n: int, numerator: int) -> int:
    return -(-numerator * n // 100)


def subsets(n: int, numerator: int) -> int:
    """Entries of a small set: all its subsets of a size that a partner may share."""
    return sum(math.comb(n, d) for d in range(n - least_partner(n, numerator) + 1))


#: Results of ``parts`` and ``boundary``.
_KNOWN_PARTS: dict[tuple[int, int, int], tuple[int, int]] = {}
_KNOWN_BOUNDARY: dict[int, int] = {}


def parts(low: int, high: int, numerator: int) -> tuple[int, int]:
    """Number of parts for partners whose larger set has ``low`` to ``high`` members, and how many may differ.

    Spare parts make it rare that a set leaves so many empty that it must be entered under those; their number
    balances the entries they cost against the chance of that, with empty parts taken as Poisson.
    """
    if (low, high, numerator) in _KNOWN_PARTS:
        return _KNOWN_PARTS[low, high, numerator]
    differ = (100 - numerator) * 2 * high // (100 + numerator)

    def cost(spare: int) -> float:
        m = differ + 1 + spare
        empty = m * math.exp(-least_partner(low, numerator) / m)
        few = sum(math.exp(-empty + k * math.log(empty) - math.lgamma(k + 1)) for k in range(spare + 1))
        return m + CROWDED_COST * max(0.0, 1 - few)

    _KNOWN_PARTS[low, high, numerator] = differ + 1 + min(range(1, 60), key=cost), differ
    return _KNOWN_PARTS[low, high, numerator]


def boundary(numerator: int) -> int:
    """Largest size for which subsets cost no more than parts, which also have their members compared."""
    if numerator not in _KNOWN_BOUNDARY:
        n = 1
        while subsets(n + 1, numerator) <= sum(parts(n + 1, math.ceil((n + 1) * CLASS_RATIO), numerator)) + n + 1:
            n += 1
        _KNOWN_BOUNDARY[numerator] = n
    return _KNOWN_BOUNDARY[numerator]


def class_bounds(largest: int, numerator: int) -> list[int]:
    """Lower bounds of the size classes of large sets, one beyond ``largest`` included."""
    out = [boundary(numerator) + 1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * CLASS_RATIO)))
    return out


def sets_of(texts: pa.Array, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, ascending, and each text's offsets."""
    codes, offsets, words = split_words(texts, lower=True)
    hashes, at = shingle_hashes(word_hashes(words)[codes], offsets, words_each)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])[:len(doc)]
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))]).astype("int64")


def _members(offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of some sets, and for each its set."""
    n = np.diff(offsets)[own]
    to = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(offsets[own] - to[:-1], n) + np.arange(to[-1]), np.repeat(np.arange(len(own)), n)


def entries(members: np.ndarray, offsets: np.ndarray, numerator: int) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers and keys of all list entries of some sets."""
    sizes = np.diff(offsets)
    who, keys = [], []
    with np.errstate(over="ignore"):
        value = mix(members + np.uint64(0x632BE59BD9B4E019))
        for i in np.flatnonzero((sizes > 0) & (sizes <= boundary(numerator))).tolist():
            own = value[offsets[i]:offsets[i + 1]]
            n, total = len(own), own.sum(dtype="uint64")
            for d in range(n - least_partner(n, numerator) + 1):
                gone = np.array([sum(map(int, c)) & ((1 << 64) - 1) for c in combinations(own.tolist(), d)], "uint64")
                keys.append(mix(total - gone + np.uint64(n - d)))
                who.append(np.full(len(gone), i))
        bounds = class_bounds(int(sizes.max(initial=0)) * 100 // numerator + 1, numerator)
        largest = sizes * 100 // numerator  # size of the largest partner
        for low, after in zip(bounds, bounds[1:]):
            # Partners are met in the class of the larger set.
            own = np.flatnonzero((sizes < after) & (largest >= low) & (sizes > 0))
            if not len(own):
                continue
            m, differ = parts(low, after - 1, numerator)
            at, owner = _members(offsets, own)
            part = owner * m + (mix(members[at] ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)).astype("int64") % m
            order = np.argsort(part, kind="stable")
            place = part[order]
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            total = np.add.reduceat(value[at][order], head)
            full = place[head]
            tag = np.uint64(low) << np.uint64(20)
            who.append(own[full // m])
            keys.append(mix(total + mix(tag + (full % m).astype("uint64"))))
            filled = np.bincount(full // m, minlength=len(own))
            for i in np.flatnonzero(m - filled >= m - differ).tolist():
                none = np.setdiff1d(np.arange(m), full[full // m == i] % m)
                who.append(np.full(len(none), own[i]))
                keys.append(mix(mix(tag + none.astype("uint64")) ^ np.uint64(0x9FB21C651E98DF25)))
    if not who:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    return np.concatenate(who), np.concatenate(keys).view("int64")


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[np.argsort(owner, kind="stable")]))


def sketches(members: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Parity sketches: each member flips one of twice as many bits as there are members, rounded up to a power of two."""
    sizes = np.diff(offsets)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1)))).astype("int64")
    ends = np.concatenate([[0], np.cumsum(bits)])
    where = np.repeat(ends[:-1], sizes) + (mix(members ^ np.uint64(0xA0761D6478BD642F)) & np.repeat(bits - 1, sizes).astype("uint64")).astype("int64")
    packed = np.packbits((np.bincount(where, minlength=ends[-1]) & 1).astype("uint8"), bitorder="little")
    return [packed[a // 8:b // 8].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def may_link(sizes: np.ndarray, sketch: list[bytes], numerator: int) -> np.ndarray:
    """Pairs that their sketches do not tell apart; longer sketches are folded to the shortest."""
    least = min(map(len, sketch))
    rows = []
    for raw in sketch:
        bits = np.frombuffer(raw, "uint8")
        rows.append(np.bitwise_xor.reduce(bits.reshape(-1, least), axis=0))
    on = np.unpackbits(np.stack(rows), axis=1).astype("float32")
    total = on.sum(axis=1)
    differ = total[:, None] + total[None, :] - 2 * (on @ on.T)
    both = sizes[:, None] + sizes[None, :]
    return differ <= both - 2 * (-(-numerator * both // (100 + numerator)))


def described(docs: DataFrame, words_each: int, numerator: int) -> DataFrame:
    """One row a document: its id, its text's hash, and its set's size, digest, sketch and entries.

    Of equal sets a slice enters one.  Of a list that is long within the slice it enters one set in ``wide``, and the
    others name that one in ``near``: a list that very many share is then a row a slice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                members, offsets = sets_of(part.column("text"), words_each)
                n = part.num_rows
                digest = [hashlib.blake2b(members[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                s = np.frombuffer(b"".join(digest), "<i8")[::2]
                _, first = np.unique(np.frombuffer(b"".join(digest), "V16"), return_index=True)
                lens = np.zeros(n, "int64")
                lens[first] = np.diff(offsets)[first]
                at, _ = _members(offsets, np.sort(first))
                who, keys = entries(members[at], np.concatenate([[0], np.cumsum(lens)]), numerator)
                order = np.lexsort((s[who], keys))
                who, keys = who[order], keys[order]
                head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
                size = np.diff(np.append(head, len(keys)))
                long = np.repeat(size > LONG_IN_SLICE, size)
                least = np.zeros(len(keys), dtype=bool)
                least[head] = True
                to = np.repeat(who[head], size)
                met = np.unique(np.stack([who[long & ~least], s[to[long & ~least]]]), axis=1)
                wide = long & least
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), part.column("h"), pa.array(np.diff(offsets)), pa.array(digest, pa.binary()), pa.array(s),
                    pa.array(sketches(members, offsets), pa.binary()), _lists(keys[~long], who[~long], n),
                    _lists(keys[wide], who[wide], n), _lists(met[1], met[0].astype("int64"), n)],
                    ["doc", "h", "n", "set_id", "s", "sketch", "keys", "wide", "near"])

    return hold(docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, FACTS), "join-facts")


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links: breadth first, a row of the matrix at a time."""
    left = np.ones(len(links), dtype=bool)
    out = []
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(links[i] & left).tolist():
                left[j] = False
                out.append((i, j))
                queue.append(j)
    return out


def linked(sets: list[np.ndarray], numerator: float) -> np.ndarray:
    """Which of some sets link, by exact overlaps."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    column = np.cumsum(new) - 1
    times = np.bincount(column)
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    shared = times[column] > 1
    column = (np.cumsum(times > 1) - 1)[column[shared]]
    owner = owner[shared]
    both = np.diag(sizes).astype("float64")
    total = np.zeros((len(sets), len(sets)))
    width = 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        own, back = np.unique(owner[lo:hi], return_inverse=True)
        present = np.zeros((len(own), width), dtype="float32")
        present[back, column[lo:hi] - a] = 1
        total[np.ix_(own, own)] += present @ present.T
    both = np.where(np.eye(len(sets), dtype=bool), both, total)
    return 100 * both >= numerator * (sizes[:, None] + sizes[None, :] - both)


def _compare(groups: DataFrame, numerator: float) -> DataFrame:
    """Links (a, b) that span what links within each group of ``rep``, ``members``; ``g`` names the group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep")
        reps = pdf["rep"].to_numpy()
        edges = forest(linked([np.asarray(m, dtype="int64") for m in pdf["members"]], numerator))
        return pd.DataFrame([(reps[i], reps[j]) for i, j in edges], columns=["a", "b"], dtype="int64")

    return groups.groupBy("g").applyInPandas(run, "a long, b long")


class _List:
    """Reads one list after another, each by ascending s: edges from those that may link to the least of them."""

    def __init__(self, numerator: int) -> None:
        self.numerator = numerator
        self.edges: list[tuple[int, int]] = []
        self.open(None)

    def open(self, key: int | None) -> None:
        self.key, self.wide, self.sets = key, False, {}
        self.head: int | None = None

    def add(self, s: int, wide: bool, n: int, sketch: bytes) -> None:
        self.wide |= wide
        self.head = s if self.head is None else self.head
        if len(self.sets) < LONG_LIST:
            self.sets.setdefault(s, (n, sketch))
            return
        if not self.wide:
            self.wide = True
        if s != self.head:
            self.edges.append((s, self.head))

    def close(self) -> None:
        names = list(self.sets)
        if len(names) < 2:
            return
        if self.wide:
            self.edges += [(s, self.head) for s in names if s != self.head]
            return
        sizes, raw = zip(*self.sets.values(), strict=True)
        # Rows come by s, so the first of a tree is its least: members name that one, in other lists often the same.
        root = list(range(len(names)))
        for i, j in forest(may_link(np.array(sizes), raw, self.numerator)):
            root[j] = root[i]
        self.edges += [(s, names[r]) for s, r in zip(names, root, strict=True) if s != names[r]]


def _read_lists(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """Edges of all lists of a task, whose rows stand together."""
    now = _List(numerator)

    def found() -> pa.RecordBatch:
        a, b = zip(*set(now.edges), strict=True) if now.edges else ((), ())
        now.edges = []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for key, s, wide, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("key", "s", "wide", "n", "sketch")), strict=True):
            if key != now.key:
                now.close()
                now.open(key)
            now.add(s, wide, n, sketch)
        yield found()
    now.close()
    yield found()


def _passes(size: int, most: int) -> int:
    """Passes in which so many bytes are moved, so that the disk holds a share of them at a time."""
    return max(1, -(-size // max(LEAST_MOVED, most)))


def _shared_lists(whole: DataFrame, members: int) -> list[DataFrame]:
    """key, s, wide: entries of the lists that more than one set is entered in, some of the keys in each table."""
    spark = whole.sparkSession
    n = _passes(ENTRY_BYTES * (whole.agg(F.sum(F.size("keys") + F.size("wide"))).first()[0] or 0), ENTRIES_MOVED * members)
    alone = Window.partitionBy("key")
    out = []
    for i in range(n):
        own = F.pmod("key", F.lit(n)) == i
        rows = whole.select("s", F.explode("keys").alias("key"), F.lit(False).alias("wide")).filter(own).union(
            whole.select("s", F.explode("wide").alias("key"), F.lit(True).alias("wide")).filter(own))
        out.append(hold(rows.withColumn("low", F.min("s").over(alone)).withColumn("high", F.max("s").over(alone)).filter(
            (F.col("low") < F.col("high")) | F.col("wide")).select("key", "s", "wide"), "join-lists"))
        del rows
        release(spark)
    return out


def _candidates(whole: DataFrame, facts: DataFrame, numerator: int) -> DataFrame:
    """node, label: sets (s) that may link with another, and their connected group.  Lets go of ``whole``.

    Every list is read whole; lists are dealt into passes by their keys, as entries with their sketches can take many
    times the texts.
    """
    spark = facts.sparkSession
    members = facts.agg(F.sum("n")).first()[0] or 0
    tables = _shared_lists(whole, members)
    let_go(whole)
    shared = reduce(DataFrame.union, tables)
    drawn = hold(facts.select("s", "n", "sketch").dropDuplicates(["s"]), "join-sketches")
    each = SKETCHED_BYTES + F.octet_length("sketch")
    n = _passes(shared.groupBy("s").count().join(drawn, "s").agg(F.sum(F.col("count") * each)).first()[0] or 0, SKETCHED_MOVED * members)
    found = []
    for i in range(n):
        lists = shared.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i).join(drawn, "s").repartition("key").sortWithinPartitions("key", "s")
        found.append(hold(lists.mapInArrow(lambda batches: _read_lists(batches, numerator), "a long, b long").distinct(), "join-far"))
        del lists
        release(spark)
    near = facts.select(F.col("s").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    edges = hold(reduce(DataFrame.union, found).union(near).distinct(), "join-candidates")
    let_go(*tables, drawn)
    return min_label(edges)


def _firsts(docs: DataFrame, *columns: str) -> DataFrame:
    """One row for each doc_id and text, by ``_d`` and ``_h``, with some columns of it.

    Of rows that agree in both, each partition sends one.
    """
    keyed = docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)), "_h": F.xxhash64("text")}).select("_d", "_h", *columns)
    nth = F.row_number().over(Window.partitionBy("_d", "_h").orderBy(F.lit(0)))
    return keyed.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def _links(docs: DataFrame, whole: DataFrame, facts: DataFrame, sets: DataFrame, words_each: int, numerator: int) -> DataFrame:
    """Links (a, b) between different sets, by their numbers; they span every true component."""
    groups = _candidates(whole, facts, numerator)
    chosen = sets.join(groups, sets["s"] == groups["node"]).select(
        F.coalesce("first.id", F.lit(NAMELESS)).alias("_d"), F.col("first.h").alias("_h"), F.col("number").alias("rep"), F.col("label").alias("k"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                members, offsets = sets_of(part.column("text"), words_each)
                yield pa.RecordBatch.from_arrays([
                    part.column("rep"), part.column("k"), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(members.view("int64")))],
                    ["rep", "k", "n", "members"])

    full = hold(_firsts(docs, "text").join(chosen, ["_d", "_h"]).select("rep", "k", "text").mapInArrow(
        build, "rep long, k long, n long, members array<long>"), "join-sets")
    release(facts.sparkSession)
    links = hold(spanning_links(full, numerator), "join-spanning")
    let_go(full)
    return links


def spanning_links(sets: DataFrame, numerator: float) -> DataFrame:
    """Links (a, b) that span what links within each group ``k`` of sets ``rep``, ``k``, ``n``, ``members``."""
    sizes = hold(sets.groupBy("k").agg(F.count("*").alias("sets"), F.sum("n").alias("size")).withColumn(
        "blocks", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("size") / BLOCK_MEMBERS))), "join-groups")
    total, count = sizes.filter("blocks = 1").agg(F.sum("size"), F.sum("sets")).first()
    bins = max(1, -(-(total or 0) // BLOCK_MEMBERS), -(-(count or 0) // BLOCK_SETS))
    # Groups that fit a block share one with others; comparing across them does no harm.
    little = sets.join(sizes.filter("blocks = 1").select("k"), "k").select(
        F.pmod(F.xxhash64("k"), F.lit(bins)).alias("g"), "rep", "members")
    big = sets.join(sizes.filter("blocks > 1"), "k").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # Each block with itself and with the first one.
    starred = big.select("k", F.explode(F.when(F.col("block") == 0, every).otherwise(F.array("block"))).alias("block"), "rep", "members")
    one = hold(_compare(little, numerator).union(
        _compare(starred.select(F.xxhash64("k", "block").alias("g"), "rep", "members"), numerator)), "join-links")
    return one if sizes.filter("blocks > 1").isEmpty() else one.union(_rest(big, one, numerator))


def _rest(big: DataFrame, one: DataFrame, numerator: float) -> DataFrame:
    """Links of those that are not yet in the largest component of a large group, against the whole group."""
    labels = min_label(one)
    known = hold(big.join(labels, big["rep"] == labels["node"], "left").select(
        "k", "rep", "block", "blocks", F.coalesce("label", "rep").alias("component")), "join-known")
    counts = known.groupBy("k", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("k").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    loose = known.join(largest, "k").filter("component <> largest").select("k", "rep")
    rounds = loose.groupBy("k").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("rounds"))
    place = F.pmod(F.xxhash64("rep", F.lit("loose")), F.col("rounds"))
    sets = big.join(rounds, "k")
    left = sets.join(loose, ["k", "rep"]).select(
        "k", place.alias("round"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "rep", "members")
    right = sets.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("round"), "block", "rep", "members")
    met = left.unionByName(right).select(F.xxhash64("k", "round", "block").alias("g"), "rep", "members")
    return hold(_compare(met, numerator), "join-rest")


def _sets(docs: DataFrame, words_each: int, numerator: int) -> tuple[DataFrame, DataFrame]:
    """All rows described, and of each set that is not empty a number, its ``first`` row, its rows, and the ``root`` of its component.

    A set's first row is the one of least doc_id, of least text hash among those, and last of all one without an id.
    Every set takes part, whatever the ids of its rows; a root is the number of a set.
    """
    whole = described(docs, words_each, numerator)
    # Entries are most of it and go once the lists are read.
    facts = hold(whole.drop("keys", "wide"), "join-slim")
    first = F.min(F.struct(F.col("doc").isNull().alias("nameless"), F.col("doc").alias("id"), "h"))
    # Numbers are written with the sets, so they are read alike ever after.
    sets = hold(facts.filter("n > 0").groupBy("set_id", "s").agg(first.alias("first"), F.count("*").alias("rows")).withColumn(
        "number", F.monotonically_increasing_id()), "join-numbers")
    labels = min_label(_links(docs, whole, facts, sets, words_each, numerator))
    return facts, hold(sets.join(labels, sets["number"] == labels["node"], "left").select(
        "set_id", "first", "rows", F.coalesce("label", "number").alias("root"), F.col("label").isNotNull().alias("met")), "join-roots")


def linked_components(docs: DataFrame, words_each: int = SHINGLE_WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    The component's name is the least doc_id reachable by links; rows without an id link like others, but name a
    component only where no row has one, and then it is null.  A document without words links with nothing.  Rows of
    one doc_id each keep a row and link by their own texts.
    """
    facts, sets = _sets(docs, words_each, numerator)
    names = sets.groupBy("root").agg(F.min("first.id").alias("name"))
    # A row alone in its set and component is its own; the others may be very many of one set, so both sides are plain
    # tables and the join can be split.
    shared = hold(sets.join(names, "root").filter("rows > 1 or met").select("set_id", "name", F.lit(True).alias("shared")), "join-names")
    slim = facts.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "set_id")
    return slim.join(shared, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("shared") & (F.col("n_shingles") > 0), F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words_each: int = SHINGLE_WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """One row of each group of linked documents, with all its columns: the one of least doc_id, then of least text hash.

    A row without an id stays only where its group has none with one.  Documents without words are no group and stay.
    """
    facts, sets = _sets(docs, words_each, numerator)
    kept = hold(sets.groupBy("root").agg(F.min("first").alias("first")).select(
        F.coalesce("first.id", F.lit(NAMELESS)).alias("_d"), F.col("first.h").alias("_h")), "join-kept")
    let_go(facts, sets)
    columns = [f"`{c}`" for c in docs.columns]
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    return _firsts(docs, *columns).join(kept, ["_d", "_h"]).select(*columns).union(docs.filter(wordless))
