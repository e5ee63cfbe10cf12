"""Provenance records: sources and steps, merged as results are combined."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.constants import VINTAGE_FIRST
from emberline.operators.rank import cumulative

SOURCE_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("vintage", T.IntegerType()),
    T.StructField("licence", T.StringType()),
    T.StructField("licence_from", T.StringType()),
    T.StructField("downloaded", T.StringType()),
])
STEP_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("time", T.StringType()),
    T.StructField("fun", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("notes", T.StringType()),
])


def _scalar(value) -> str:
    """A parameter as text, sequences in full."""
    if isinstance(value, dict):
        return ", ".join(f"{k}={_scalar(v)}" for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return ", ".join(_scalar(v) for v in value)
    return str(value)


@dataclass(frozen=True)
class Provenance:
    """An immutable record: every change returns a new one."""

    sources: tuple[dict, ...] = ()
    steps: tuple[dict, ...] = field(default=())

    def source(self, dataset: str, **fields) -> Provenance:
        known = {f.name for f in SOURCE_SCHEMA} - {"seq"}
        unknown = set(fields) - known
        if unknown:
            raise TypeError(f"unknown source fields {sorted(unknown)}")
        return self.merge(Provenance(({"dataset": dataset, **fields},)))

    def step(self, fun: str, params: dict | None = None, notes: str | None = None) -> Provenance:
        stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        kept = {k: _scalar(v) for k, v in (params or {}).items() if v is not None}
        return replace(self, steps=self.steps + ({"time": stamp, "fun": fun, "params": kept, "notes": notes},))

    def merge(self, other: Provenance) -> Provenance:
        """Sources once per (dataset, vintage, download); steps in order."""
        seen, sources = set(), []
        for s in self.sources + other.sources:
            key = (s.get("dataset"), s.get("vintage"), s.get("downloaded"))
            if key not in seen:
                seen.add(key)
                sources.append(s)
        return Provenance(tuple(sources), self.steps + other.steps)

    def vintage(self) -> int | None:
        """Year of the fuel source: forest survey first, else the first dated source."""
        for want in VINTAGE_FIRST:
            for s in self.sources:
                if s["dataset"] == want and s.get("vintage") is not None:
                    return int(s["vintage"])
        return next((int(s["vintage"]) for s in self.sources if s.get("vintage") is not None), None)

    def sources_df(self, spark: SparkSession) -> DataFrame:
        rows = [tuple([i + 1] + [s.get(f.name) for f in SOURCE_SCHEMA.fields[1:]]) for i, s in enumerate(self.sources)]
        return spark.createDataFrame(rows, SOURCE_SCHEMA)

    def steps_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, s["time"], s["fun"], s["params"], s["notes"]) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, STEP_SCHEMA)


def merge_sources(sources: DataFrame, key: list[str], order: str) -> DataFrame:
    """Deduplicate a source table over many runs: the earliest row of each key wins.

    An aggregate rather than a row number, so a dataset that is cited by a third
    of all runs is combined before the shuffle.
    """
    rest = [c for c in sources.columns if c not in key and c != order]
    first = sources.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("f"))
    return first.select(*key, *[F.col(f"f.{c}").alias(c) for c in [order, *rest]])


def renumber_steps(steps: DataFrame, run: str, order: str) -> DataFrame:
    """Number the steps of each run anew, by a numeric order, after records are concatenated.

    Positions are counted through value ranges, so one long run does not end up in one task.
    """
    counts = steps.groupBy(run, order).agg(F.count("*").alias("n"))
    place = cumulative(counts, order, ["n"], [run]).select(run, order, (F.col("n_before") + 1).cast("int").alias("seq"))
    return steps.drop("seq").join(place, [run, order])


def resolve_vintage(sources: DataFrame, run: str) -> DataFrame:
    """Fuel vintage of each run from its dated sources.

    The preferred datasets come first, in order, then the first dated source.
    """
    rank = F.lit(len(VINTAGE_FIRST))
    for i, name in reversed(list(enumerate(VINTAGE_FIRST))):
        rank = F.when(F.col("dataset") == name, F.lit(i)).otherwise(rank)
    return (
        sources.filter(F.col("vintage").isNotNull())
        .groupBy(run)
        .agg(F.min(F.struct(rank.alias("k"), F.col("seq"), F.col("vintage"))).alias("f"))
        .select(run, F.col("f.vintage").alias("vintage"))
    )


def licences(sources: DataFrame, order: str = "seq") -> DataFrame:
    """One row per dataset, the first record winning, and whether it bars commercial use."""
    first = merge_sources(sources.select("dataset", order, "licence", "licence_from"), ["dataset"], order)
    return first.select(
        "dataset", "licence", "licence_from",
        (F.col("licence").isNotNull() & F.coalesce(F.col("licence"), F.lit("")).contains("NC")).alias("non_commercial"),
    )
