"""Divergence of sources by pair tasks: sorted term arrays of two groups are merged, each pair once for both ways.

A group is a (lang, source).  Its probabilities over the kept terms of its language are whole numbers in units of a
billionth, smoothed by one, and a term costs floor((p - q)^2 / q).  Texts are counted where they are read; kept terms get
a number within their shard, a share of the language's terms of bounded size.  A group's terms in a shard are one sorted
array of numbers and one of counts.  Both groups of an unordered pair send their arrays to the same task, shard by shard:
a galloping intersection finds the overlap, which is priced both ways, as is what only one side has.  Terms that neither
side has all cost the same and are only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.batches import slices
from emberline.session import hold

#: Probabilities are in units of 1 / UNIT.
UNIT = 1_000_000_000
#: Documents of the language that a kept term occurs in at least; ranks that part ``term`` lists.
LEAST_DOCS, TOP = 3, 200
#: Terms of a shard and array entries of a pair task, on average.
SHARD_TERMS, TASK_ENTRIES = 2048, 2_000_000
#: Everything that is no letter A to Z, in either case, and below U+0080.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group; null columns are ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                group = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
                names = pd.MultiIndex.from_arrays([part.column(c).to_pandas() for c in ("lang", "source")])
                g, known = names.factorize()
                lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), NO_TERM)
                ends = lists.offsets.to_numpy()
                values = lists.values.slice(ends[0], ends[-1] - ends[0])
                coded = values.dictionary_encode()
                full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
                word = coded.indices.to_numpy(zero_copy_only=False)[full].astype("int64")
                doc = np.repeat(np.arange(part.num_rows), np.diff(ends))[full]
                # A document's terms first, then those of its group.
                seen, times = np.unique(doc * (len(coded.dictionary) + 1) + word, return_counts=True)
                doc, word = np.divmod(seen, len(coded.dictionary) + 1)
                both, back, docs_of = np.unique(g[doc] * (len(coded.dictionary) + 1) + word, return_inverse=True, return_counts=True)
                own, word = np.divmod(both, len(coded.dictionary) + 1)
                _, at = np.unique(g, return_index=True)
                row = group.take(pa.array(at[own]))
                yield pa.RecordBatch.from_arrays([
                    row.field("lang"), row.field("source"), coded.dictionary.take(pa.array(word)),
                    pa.array(np.bincount(back, times, len(both)).astype("int64")), pa.array(docs_of.astype("int64"))],
                    ["lang", "source", "term", "n", "docs"])

    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = clean.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + kept)), exact for any long."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 1)
    return (1 + F.call_function("div", wide, (total + kept).cast("decimal(20,0)"))).cast("long")


def cost(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); (p - q)^2 is at most UNIT^2."""
    return F.call_function("div", (p - q) * (p - q), q)


def probabilities(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """As :func:`probability`; counts beyond 64 bits go through Python's whole numbers."""
    if not len(n) or (int(n.max()) + 1) * UNIT < 1 << 63:
        return 1 + (n + 1) * UNIT // (total + kept)
    return np.array([1 + (x + 1) * UNIT // (total + kept) for x in n.tolist()], "int64")


def gallop(small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common values in two sorted arrays without repeats.

    From the place of the last but a few before it, each value of the smaller array strides ahead by doubling steps and
    then halves the last one; all values of the array stride at once.
    """
    if not len(small) or not len(large):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    stride = 32
    low = np.repeat(np.searchsorted(large, small[::stride]), stride)[:len(small)]
    step = np.ones(len(small), "int64")
    going = np.arange(len(small))
    while len(going):
        ahead = np.minimum(low[going] + step[going], len(large))
        short = (ahead < len(large)) & (large[np.minimum(ahead, len(large) - 1)] < small[going])
        going = going[short]
        low[going] = ahead[short]
        step[going] *= 2
    high = np.minimum(low + step, len(large))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = open_ & (large[np.minimum(mid, len(large) - 1)] < small)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    hit = (low < len(large)) & (large[np.minimum(low, len(large) - 1)] == small)
    return np.flatnonzero(hit), low[hit]


def merged_prices(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], kept: int) -> tuple[int, int, int]:
    """Cost of a against b and of b against a over the terms that one of them has, and how many these are.

    Each side is its term numbers, their counts, and its total count.
    """
    swap = len(a[0]) > len(b[0])
    i, j = gallop(b[0], a[0]) if swap else gallop(a[0], b[0])
    i, j = (j, i) if swap else (i, j)
    only_a, only_b = np.ones(len(a[0]), dtype=bool), np.ones(len(b[0]), dtype=bool)
    only_a[i], only_b[j] = False, False
    none = np.zeros(1, "int64")
    p, q = probabilities(a[1], a[2], kept), probabilities(b[1], b[2], kept)
    p0, q0 = probabilities(none, a[2], kept), probabilities(none, b[2], kept)
    forth = back = 0
    for x, y in ((p[i], q[j]), (p[only_a], q0), (p0, q[only_b])):
        square = (x - y) ** 2
        forth += int((square // y).sum())
        back += int((square // x).sum())
    return forth, back, len(p) + len(q) - len(i)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language departs from the others and from the whole.

    Part ``pair`` prices a source against each other source of its language over all kept terms; part ``term`` lists the
    terms that a source has more often than its language, at most ``top``.  Null lang, source and text are ''.  A group
    without terms takes part; a language without kept terms has pairs of value 0; a language of one source has no
    pair.  Repeated rows count each.  Other columns play no part.
    """
    spark = docs.sparkSession
    groups = hold(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct().select(
        "*", F.monotonically_increasing_id().alias("g")), "divergence-groups")
    counts = hold(counted_terms(docs), "divergence-counts")
    kept = hold(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= least_docs).select("lang", "term", "all_n"), "divergence-kept")
    langs = hold(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total")).withColumn(
        "shards", F.ceil(F.col("kept") / SHARD_TERMS)), "divergence-langs")
    # A language's facts meet its terms once; the shard is then a hash, so no task holds a whole language.
    facts = kept.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    numbered = facts.withColumn("id", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")))
    own = hold(counts.select("lang", "source", "term", "n").join(numbered.drop("shards"), ["lang", "term"]), "divergence-own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = hold(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", "g", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "divergence-sized")

    one = sized.select("lang", F.col("source").alias("s"), F.col("g").alias("a"), F.col("total").alias("at"), "kept")
    two = sized.select("lang", F.col("source").alias("t"), F.col("g").alias("b"), F.col("total").alias("bt"))
    pairs = hold(one.join(two, "lang").filter("a < b"), "divergence-pairs")
    arrays = hold(own.groupBy("lang", "source", "shard").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms")).join(
        sized.select("lang", "source", "g"), ["lang", "source"]).select("g", "shard", F.col("terms.id").alias("ids"), F.col("terms.n").alias("n")), "divergence-arrays")
    entries = arrays.join(pairs.select(F.explode(F.array("a", "b")).alias("g")).groupBy("g").agg(F.count("*").alias("times")), "g").agg(
        F.sum(F.size("ids") * F.col("times"))).first()[0] or 0
    bins = max(1, -(-entries // TASK_ENTRIES))
    task = F.pmod(F.xxhash64("a", "b", "shard"), F.lit(bins)).alias("task")
    sides = [pairs.select(F.col(me).alias("g"), "a", "b", "at", "bt", "kept").join(arrays, "g").select(
        task, "a", "b", "shard", "at", "bt", "kept", "ids", "n") for me in ("a", "b")]
    sides[1] = sides[1].toDF(*sides[1].columns)  # columns of its own: both sides come from the same tables

    def price(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [{(r.a, r.b, r.shard): r for r in side.itertuples(index=False)} for side in (left, right)]
        nothing = np.zeros(0, "int64")
        out: dict[tuple[int, int], list[int]] = {}
        for key in rows[0].keys() | rows[1].keys():
            x, y = (r.get(key) for r in rows)
            r = x or y
            got = merged_prices((x.ids if x else nothing, x.n if x else nothing, r.at), (y.ids if y else nothing, y.n if y else nothing, r.bt), r.kept)
            out[key[:2]] = [u + v for u, v in zip(out.get(key[:2], (0, 0, 0)), got, strict=True)]
        return pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["a", "b", "forth", "back", "had"], dtype="int64")

    met = sides[0].groupBy("task").cogroup(sides[1].groupBy("task")).applyInPandas(price, "a long, b long, forth long, back long, had long")
    priced = met.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("forth", "back", "had")))
    nil = F.lit(0).cast("long")
    p0, q0 = (probability(nil, F.col(c), F.col("kept")) for c in ("at", "bt"))
    absent = F.col("kept") - F.coalesce("had", nil)
    # Without kept terms nothing is priced, and nothing is divided by zero.
    value = lambda c, p, q: F.when(F.col("kept") > 0, F.coalesce(c, nil) + absent * cost(p, q)).otherwise(nil)
    both = pairs.join(priced, ["a", "b"], "left").select("lang", F.explode(F.array(
        F.struct(F.col("s").alias("source"), F.col("t").alias("item"), value("forth", p0, q0).alias("value")),
        F.struct(F.col("t").alias("source"), F.col("s").alias("item"), value("back", q0, p0).alias("value")))).alias("r"))
    ahead = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = both.select("lang", "r.source", F.lit("pair").alias("part"), "r.item", "r.value").withColumn("rank", F.row_number().over(ahead))

    # A group's total is one number for many rows: it is joined before the rows of the group are ranked.
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    q = probability(F.col("all_n"), F.col("all_total"), F.col("kept"))
    terms = own.join(sized.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    term = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", cost(F.col("p"), F.col("q")).alias("value")).withColumn(
        "rank", F.row_number().over(ahead)).filter(F.col("rank") <= top)
    return pair.unionByName(term)


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), said AS (SELECT d, lang, source, unnest(ts) AS term FROM docs
), kept AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM said GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS total FROM kept GROUP BY lang
), own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(o.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN own o USING (lang, source) GROUP BY g.lang, g.source
), priced AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         1 + (1000000000 * (coalesce(o.n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000 * (k.all_n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::HUGEINT AS value
  FROM priced x JOIN priced y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM priced WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
WHERE part = 'pair' OR rank <= 200
"""
