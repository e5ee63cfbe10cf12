"""Fuel sources: class cells, their lookup, and the layers derived from both."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.errors import BadLookup, BadWeights, EmberError, RoleRefused, UnknownName, notice
from emberline.functions.constants import FUEL_WEIGHTS, SOURCE_RANK, values_table
from emberline.grid import CELL, GridSpec, require_same_grid
from emberline.operators.provenance import Provenance
from emberline.operators.raster import align, burn_attribute


def weights_table(spark, overrides: dict[str, float] | None = None) -> DataFrame:
    """Availability weight per fuel type; overrides must name known types and lie in [0, 1]."""
    overrides = overrides or {}
    unknown = set(overrides) - set(FUEL_WEIGHTS)
    if unknown:
        raise BadWeights(f"unknown fuel types {sorted(unknown)}")
    if any(not 0 <= w <= 1 for w in overrides.values()):
        raise BadWeights("weights must lie in [0, 1]")
    rows = [(k, float(v)) for k, v in {**FUEL_WEIGHTS, **overrides}.items()]
    return values_table(spark, ["fuel_type", "weight"], rows)


def burnable(cells: DataFrame, lookup: DataFrame, out: str = "burnable") -> DataFrame:
    """Class to 0/1; a class the lookup does not know stays null, never 'not burnable'."""
    table = lookup.select(F.col("code").alias("class"), F.col("burnable").cast("int").alias(out))
    return cells.join(table, "class", "left")


def fuel_type(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Class to fuel type; several codes may share one."""
    table = lookup.select(F.col("code").alias("class"), "fuel_type")
    return cells.join(table, "class", "left")


def availability(cells: DataFrame, lookup: DataFrame, weights: DataFrame, out: str = "availability") -> DataFrame:
    """Class to type to weight; a lookup type without a weight is an error."""
    lacking = lookup.select("fuel_type").filter(F.col("fuel_type").isNotNull()).join(weights, "fuel_type", "left_anti")
    missing = lacking.agg(F.count_distinct("fuel_type").alias("n"), F.min("fuel_type").alias("first")).first()
    if missing["n"]:
        raise BadWeights(f"no weight for {missing['n']} fuel types, {missing['first']!r} among them")
    table = lookup.join(weights, "fuel_type").select(F.col("code").alias("class"), F.col("weight").alias(out))
    return cells.join(table, "class", "left")


def unmatched(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Classes the lookup does not know, with their cells and share of all classed cells."""
    counts = cells.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("cells"))
    total = counts.agg(F.sum("cells")).scalar()
    known = lookup.select(F.col("code").alias("class"))
    return counts.withColumn("pct", 100.0 * F.col("cells") / total).join(known, "class", "left_anti")


def class_summary(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Cells per class with share, fuel type and whether it burns; most frequent first."""
    counts = cells.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("cells"))
    total = counts.agg(F.sum("cells")).scalar()
    table = lookup.select(F.col("code").alias("class"), "fuel_type", "burnable")
    return counts.withColumn("pct", 100.0 * F.col("cells") / total).join(table, "class", "left").orderBy(
        F.desc("cells"), "class")


def shared_codes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").intersect(b.select("code"))


def code_collisions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Codes both lookups define with different fuel types."""
    right = b.select("code", F.col("fuel_type").alias("other_type"))
    return a.join(right, "code").filter(F.col("fuel_type") != F.col("other_type")).select("code", "fuel_type", "other_type")


def union_lookups(*lookups: DataFrame) -> DataFrame:
    """Union of lookups, the earlier table winning a code."""
    parts = [t.withColumn("_p", F.lit(i)) for i, t in enumerate(lookups)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("code", "_p")]
    return both.groupBy("code").agg(F.min_by(F.struct(*rest), "_p").alias("f")).select("code", "f.*")


def source_order(primary: str, secondary: str, hierarchy: str = "auto") -> bool:
    """Whether the first-named source decides a cell both map."""
    if hierarchy == "auto":
        a, b = (max((SOURCE_RANK.get(p, 0) for p in n.split("+")), default=0) for n in (primary, secondary))
        return not (a and b and b > a)
    if hierarchy not in ("primary_first", "secondary_first"):
        raise EmberError(f"unknown hierarchy '{hierarchy}'")
    return hierarchy == "primary_first"


def merge_classes(primary: DataFrame, secondary: DataFrame, p_label: str, s_label: str) -> DataFrame:
    """Primary class where it exists, else secondary; ``source`` records which decided.

    The result keeps the primary's rows.  A ``source`` column the primary already
    carries survives.
    """
    if p_label == s_label:
        p_label, s_label = f"{p_label}:primary", f"{s_label}:secondary"
    s = secondary.select(*CELL, F.col("class").alias("_s"))
    p_src = F.col("source") if "source" in primary.columns else F.lit(p_label)
    both = primary.join(s, CELL, "left")
    src = F.when(F.col("class").isNotNull(), p_src).when(F.col("_s").isNotNull(), F.lit(s_label))
    return both.withColumn("source", src).withColumn("class", F.coalesce("class", "_s")).drop("_s")


def attach(primary: DataFrame, extra: DataFrame, columns: list[str]) -> DataFrame:
    """Carry further registers beside the class without arbitration; a repeated name is refused."""
    again = set(columns) & set(primary.columns)
    if again:
        raise EmberError(f"columns {sorted(again)} exist already")
    return primary.join(extra.select(*CELL, *columns), CELL, "left")


def attach_coverage(attached: DataFrame, column: str) -> DataFrame:
    """Share of classed cells that carry the attached value."""
    both = F.count_if(F.col("class").isNotNull() & F.col(column).isNotNull())
    return attached.agg(F.count("class").alias("classed"), both.alias("covered"),
                        (100.0 * both / F.count("class")).alias("pct"))


@dataclass(frozen=True)
class FuelSource:
    """A class register and named metrics on one grid, with lookup, vintages and record."""

    df: DataFrame
    grid: GridSpec
    kind: str
    lookup: DataFrame | None = None
    metrics: dict[str, str | None] = field(default_factory=dict)
    vintages: dict[str, int] = field(default_factory=dict)
    prov: Provenance = field(default_factory=Provenance)

    @classmethod
    def from_polygons(cls, polygons: DataFrame, grid: GridSpec, kind: str, lookup: DataFrame, code: str,
                      fid: str = "fid", vintage: int | None = None, touches: bool = False) -> FuelSource:
        cells = burn_attribute(polygons, grid, fid, [code], touches=touches)
        cells = grid.complete(cells.select(*CELL, F.col(code).cast("string").alias("class")))
        return cls.from_cells(cells, grid, kind, lookup, vintage=vintage)

    @classmethod
    def from_cells(cls, cells: DataFrame, grid: GridSpec, kind: str, lookup: DataFrame | None = None,
                   metrics: dict[str, str | None] | None = None, vintage: int | None = None) -> FuelSource:
        if "class" in cells.columns and lookup is None:
            raise BadLookup("a class register needs a lookup")
        prov = Provenance().source(kind, vintage=vintage).step("fuel_source", {"type": kind, "res": grid.res})
        return cls(cells, grid, kind, lookup, metrics or {}, {kind: vintage} if vintage else {}, prov)

    @property
    def registers(self) -> list[str]:
        has_class = ["categorical"] if "class" in self.df.columns else []
        return has_class + (["continuous"] if self.metrics else [])

    def categorical(self) -> DataFrame:
        if "categorical" not in self.registers:
            raise RoleRefused("this source has no class register")
        return self.df.select(*CELL, *[c for c in self.df.columns if c not in CELL and c not in self.metrics])

    def continuous(self) -> DataFrame:
        if not self.metrics:
            raise RoleRefused("this source has no measured register")
        return self.df.select(*CELL, *self.metrics)

    def metric(self, name: str | None = None) -> DataFrame:
        if name is None and len(self.metrics) > 1:
            raise UnknownName(f"name one of {list(self.metrics)}")
        name = name or next(iter(self.metrics), None)
        if name not in self.metrics:
            raise UnknownName(f"no metric '{name}'; there are {list(self.metrics)}")
        return self.df.select(*CELL, F.col(name))

    def merge(self, other: FuelSource, hierarchy: str = "auto") -> FuelSource:
        """One class grid from two sources; the record names who filled what."""
        if not source_order(self.kind, other.kind, hierarchy):
            return other.merge(self, "primary_first")
        clash = code_collisions(self.lookup, other.lookup)
        if not clash.isEmpty():
            raise BadLookup("the lookups give one code two fuel types")
        second = other.categorical()
        if other.grid != self.grid:
            notice("the second source is put on the first one's grid by nearest neighbour")
            second = align(second, other.grid, self.grid, ["class"], "near")
        merged = merge_classes(self.df, second, self.kind, other.kind)
        prov = self.prov.merge(other.prov).step("fuel_merge", {"primary": self.kind, "secondary": other.kind})
        kinds = list(dict.fromkeys(self.kind.split("+") + other.kind.split("+")))
        return replace(self, df=merged, kind="+".join(kinds), lookup=union_lookups(self.lookup, other.lookup),
                       vintages={**other.vintages, **self.vintages}, prov=prov)

    def attach(self, extra: DataFrame, grid: GridSpec, metrics: dict[str, str | None]) -> FuelSource:
        """Add measured metrics, bilinear where the grid differs."""
        if grid != self.grid:
            extra = align(extra, grid, self.grid, list(metrics), "bilinear")
        return replace(self, df=attach(self.df, extra, list(metrics)), metrics={**self.metrics, **metrics},
                       prov=self.prov.step("fuel_attach", {"metrics": list(metrics)}))

    def attach_class(self, extra: DataFrame, grid: GridSpec, name: str) -> FuelSource:
        """Add a second class layer under its own name, by nearest neighbour where the grid differs."""
        layer = extra if grid == self.grid else align(extra, grid, self.grid, ["class"], "near")
        layer = layer.select(*CELL, F.col("class").alias(name))
        return replace(self, df=attach(self.df, layer, [name]), prov=self.prov.step("fuel_attach", {"class": name}))


def same_grid_sources(*sources: FuelSource) -> GridSpec:
    return require_same_grid(**{f"{i}:{s.kind}": s.grid for i, s in enumerate(sources)})
