"""Exact ranks, running totals and quantiles without one giant partition.

Rows are first combined per distinct value, so repeated values cost one row
however many there are.  The distinct values are then cut into about equal value
ranges; each range is summed on its own and shifted by the total of the ranges
below it.  No step sorts the whole column in one task, whatever the group sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.session import cut_lineage, hold, shuffle_width


def with_range(reduced: DataFrame, value: str, n: int, out: str = "_rg") -> DataFrame:
    """Add the ordinal of the value range a row falls in; monotone in the value.

    Cuts are approximate quantiles of the distinct values: only their order matters
    for exactness.  They are grouped, so a row looks into one group only and many
    cuts stay cheap.
    """
    step = max(2, math.ceil(math.sqrt(n)))
    probs = [i / (step * step) for i in range(1, step * step)]
    cuts = reduced.agg(F.percentile_approx(value, probs, 20_000).alias("c"))
    groups = cuts.select(F.transform(
        F.sequence(F.lit(0), F.lit(step - 1)), lambda i: F.slice("c", i * step + 1, F.lit(step))).alias("g")).select(
        F.transform(F.filter("g", lambda a: F.size(a) > 0), lambda a: F.struct(
            F.element_at(a, 1).alias("lo"), F.element_at(a, -1).alias("hi"), a.alias("cuts"))).alias("g"))
    v = F.col(value)
    below = F.aggregate("_cuts", F.lit(0), lambda acc, g: acc + F.when(g["hi"] < v, F.size(g["cuts"])).when(
        g["lo"] < v, F.size(F.filter(g["cuts"], lambda x: x < v))).otherwise(F.lit(0)))
    return reduced.withColumn("_cuts", groups.scalar()).withColumn(out, below).drop("_cuts")


def cumulative(reduced: DataFrame, value: str, sums: list[str], by: list[str] | None = None,
               ranges: int | None = None) -> DataFrame:
    """Add ``{s}_before`` (total below the value) and ``{s}_total`` per group.

    ``reduced`` must hold one row per group and value, no null value.  It is held once: range bounds, range totals
    and the table itself are read from there, and what stands behind it runs a single time.
    """
    by = by or []
    reduced = cut_lineage(reduced)
    n = ranges or shuffle_width(reduced.sparkSession)
    ranged = with_range(reduced, value, n)
    per_range = ranged.groupBy(*by, "_rg").agg(*[F.sum(s).alias(s) for s in sums])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = whole.orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_range.select(
        *by, "_rg",
        *[F.coalesce(F.sum(s).over(below), F.lit(0)).alias(f"_{s}_shift") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums])
    inner = Window.partitionBy(*by, "_rg").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(shift, [*by, "_rg"])
    for s in sums:
        here = F.coalesce(F.sum(s).over(inner), F.lit(0))
        out = out.withColumn(f"{s}_before", here + F.col(f"_{s}_shift"))
    return out.drop("_rg", *[f"_{s}_shift" for s in sums])


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, **counts: Column) -> DataFrame:
    """One row per group and distinct value with its row count and any extra totals."""
    extra = [c.alias(k) for k, c in counts.items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count("*").alias("n"), *extra)


def attached(df: DataFrame, table: DataFrame, keys: list[str], n: str, columns: list[str]) -> DataFrame:
    """Rows of ``df`` with the ``columns`` that ``table`` has for their ``keys``; ``n`` is how many rows a key has there.

    Keys that hold more than half a partition's share of the rows are fewer than twice the partitions, so they are
    broadcast, whatever the table's size.  Their rows, and rows without a key, need no partner after that and go through
    the join under numbers of their own: no key brings a task more than a fair share.
    """
    # The lane of the table's rows is written: a constant would be folded out of the join's keys.
    table = hold(table.select(*keys, n, *[c for c in columns if c != n], F.lit(0).alias("_lane")), "rank-values")
    width = shuffle_width(df.sparkSession)
    share = (table.agg(F.sum(n)).first()[0] or 0) / (2 * width)
    packed = F.struct(*[F.col(c) for c in columns])
    often = F.broadcast(table.filter(F.col(n) > share).select(*keys, packed.alias("_often")))
    seldom = table.filter(F.col(n) <= share).select(*keys, "_lane", packed.alias("_seldom"))
    settled = F.col("_often").isNotNull()
    for k in keys:
        settled = settled | F.col(k).isNull()
    lane = F.when(settled, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(64 * width)).cast("int")).otherwise(0)
    both = df.join(often, keys, "left").withColumn("_lane", lane).join(seldom, [*keys, "_lane"], "left")
    found = F.coalesce("_often", "_seldom")
    return both.select(*df.columns, *[found[c].alias(c) for c in columns])


def mid_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Average rank of each row (ties share it) and the group size ``{out}_n``; null stays null."""
    by = by or []
    table = cumulative(value_counts(df, value, by), value, ["n"], by).select(
        *by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(out), F.col("n_total").alias(f"{out}_n"))
    return attached(df, table, [*by, value], "n", [out, f"{out}_n"])


def percentile_rank(df: DataFrame, value: str, convention: str, out: str = "pr") -> DataFrame:
    """Mid-rank as a share.  ``centred`` is (r - 0.5)/n, ``spread`` is (r - 1)/(n - 1)."""
    ranked = mid_rank(df, value, out="_r")
    r, n = F.col("_r"), F.col("_r_n")
    if convention == "centred":
        pr = (r - 0.5) / n
    else:
        pr = F.when(n > 1, (r - 1) / (n - 1)).when(n == 1, F.lit(1.0))
    return ranked.withColumn(out, pr).drop("_r", "_r_n")


def share_at_or_below(df: DataFrame, value: str, is_ref: str, by: list[str], out: str = "percentile") -> DataFrame:
    """100 x share of the group's reference values that do not exceed each value.

    Every row is ranked, only reference rows are counted.  Null values and groups
    without reference values give null.
    """
    counts = value_counts(df, value, by, ref=F.count_if(F.col(is_ref)))
    table = cumulative(counts, value, ["ref"], by)
    share = F.when(F.col("ref_total") > 0, 100.0 * (F.col("ref_before") + F.col("ref")) / F.col("ref_total"))
    return attached(df, table.select(*by, value, "n", share.alias(out)), [*by, value], "n", [out])


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics.

    One row per group and probability: ``prob``, ``q``, ``n``.
    """
    return quantiles_of_counts(value_counts(df, value, by), value, probs, by)


def quantiles_of_counts(counts: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """As :func:`quantiles`, from one row per group and value with its count ``n``."""
    by = by or []
    table = cumulative(counts.select(*by, value, "n"), value, ["n"], by)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    spot = F.transform(wanted, lambda p: F.struct(
        p.alias("prob"), F.floor((F.col("n_total") - 1) * p).alias("k"),
        ((F.col("n_total") - 1) * p - F.floor((F.col("n_total") - 1) * p)).alias("frac")))
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")

    def holds(k: Column) -> Column:
        return (k >= first) & (k < last)

    hits = table.select(*by, F.col(value).alias("_v"), F.col("n_total"), first.alias("_a"), last.alias("_b"),
                        F.explode(F.filter(spot, lambda s: holds(s["k"]) | holds(s["k"] + 1))).alias("s"))
    k = F.col("s.k")
    got = hits.groupBy(*by, F.col("s.prob").alias("prob")).agg(
        F.max(F.when((k >= F.col("_a")) & (k < F.col("_b")), F.col("_v"))).alias("lo"),
        F.max(F.when((k + 1 >= F.col("_a")) & (k + 1 < F.col("_b")), F.col("_v"))).alias("hi"),
        F.first("s.frac").alias("frac"), F.first("n_total").alias("n"))
    q = F.when(F.col("frac") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac"))
    return got.select(*by, "prob", q.alias("q"), "n")


def auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by the rank-sum statistic with mid-ranks.

    Counts are doubles before they are multiplied.  One class only gives null.
    """
    by = by or []
    counts = value_counts(df, score, by, pos=F.count_if(F.col(positive)))
    table = cumulative(counts, score, ["n"], by)
    rank_sum = F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2))
    n1, n = F.sum("pos").cast("double"), F.sum("n").cast("double")
    agg = table.groupBy(*by).agg(rank_sum.alias("rs"), n1.alias("n_pos"), n.alias("n_all"))
    n0 = F.col("n_all") - F.col("n_pos")
    value = F.when((F.col("n_pos") > 0) & (n0 > 0),
                   (F.col("rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * n0))
    return agg.select(*by, value.alias("auc"), F.col("n_pos").cast("long").alias("n_pos"), n0.cast("long").alias("n_neg"))
