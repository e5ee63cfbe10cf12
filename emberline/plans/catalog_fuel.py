"""Queries of the fuel, map-algebra, ranking and risk operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.constants import directional_defaults, fuel_types
from emberline.functions.scalars import clamp, rh_at_temperature, signif
from emberline.grid import CELL
from emberline.operators import algebra, classify, focal, fuel, profile, rank, raster, skyline
from emberline.plans.catalog_grid import BURNABLE, _auc_sql, _focal, _ring, burnable_cells
from emberline.plans.inputs import Inputs, rd, sql
from emberline.plans.registry import query
from emberline.sources.lookup import validate_lookup


@query("exposure_by_class", "J01 N03 A02", sql(
    f"""SELECT class, fuel.burnable, count(*) AS cells, count(*) FILTER (n = 48) AS known, {rd('avg(CASE WHEN n = 48 THEN s / 48.0 END)')} AS mean_exposure
        FROM foc JOIN fuel USING (r, c) WHERE class IS NOT NULL GROUP BY ALL""", BURNABLE, _ring(100), _focal("burnable", src="fuel")))
def exposure_by_class(i: Inputs) -> DataFrame:
    cells = burnable_cells(i)
    made = focal.exposure(cells, i.grid, "burnable", kind="ember_short").select(*CELL, "exposure")
    both = cells.select(*CELL, "class", "burnable").join(made, CELL)
    return both.filter("class is not null").groupBy("class", "burnable").agg(
        F.count("*").alias("cells"), F.count("exposure").alias("known"), F.avg("exposure").alias("mean_exposure"))


@query("burnable_mask", "J01", sql('SELECT r AS "row", c AS "col", class, burnable FROM fuel', BURNABLE))
def burnable_mask(i: Inputs) -> DataFrame:
    return burnable_cells(i).select(*CELL, "class", "burnable")


@query("burnable_unmatched", "J01", sql(
    f"""SELECT class, count(*) AS cells, {rd('100.0 * count(*) / (SELECT count(class) FROM cells)')} AS pct FROM cells
        WHERE class IS NOT NULL AND class NOT IN (SELECT code FROM lookup) GROUP BY class"""))
def burnable_unmatched(i: Inputs) -> DataFrame:
    return fuel.unmatched(i.cells(), i.lookup())


@query("fuel_type_cells", "J02", sql(
    "SELECT fuel_type, count(*) AS cells FROM cells LEFT JOIN lookup ON code = class GROUP BY fuel_type"))
def fuel_type_cells(i: Inputs) -> DataFrame:
    return fuel.fuel_type(i.cells(), i.lookup()).groupBy("fuel_type").agg(F.count("*").alias("cells"))


@query("fuel_type_vocabulary", "S02", sql(
    """SELECT v.fuel_type, v.fuel_type NOT IN ('cropland', 'non_fuel') AS burnable, count(cells.r) AS cells FROM weights v
       LEFT JOIN lookup ON lookup.fuel_type = v.fuel_type LEFT JOIN cells ON code = class GROUP BY v.fuel_type"""))
def fuel_type_vocabulary(i: Inputs) -> DataFrame:
    counts = fuel.fuel_type(i.cells(), i.lookup()).groupBy("fuel_type").agg(F.count("*").alias("cells"))
    return fuel_types(i.spark).join(counts, "fuel_type", "left").fillna(0, ["cells"])


@query("lookup_validated", "S01", sql(
    "SELECT code, fuel_type, burnable, count(cells.r) AS cells FROM lookup LEFT JOIN cells ON class = code GROUP BY ALL"))
def lookup_validated(i: Inputs) -> DataFrame:
    raw = i.lookup().withColumn("burnable", F.when(F.col("burnable"), " Yes").otherwise("F"))
    counts = i.cells().groupBy(F.col("class").alias("code")).agg(F.count("*").alias("cells"))
    return validate_lookup(raw).select("code", "fuel_type", "burnable").join(counts, "code", "left").fillna(0, ["cells"])


@query("availability", "J03", sql(
    f"""SELECT r AS "row", c AS "col", {rd('weight')} AS availability FROM cells LEFT JOIN lookup ON code = class LEFT JOIN weights USING (fuel_type)"""))
def availability(i: Inputs) -> DataFrame:
    return fuel.availability(i.cells(), i.lookup(), fuel.weights_table(i.spark)).select(*CELL, "availability")


@query("availability_overridden", "M18", sql(
    f"""SELECT class, {rd("max(CASE fuel_type WHEN 'grassland' THEN 0.2 ELSE weight END)")} AS availability, count(*) AS cells
        FROM cells LEFT JOIN lookup ON code = class LEFT JOIN weights USING (fuel_type) GROUP BY class"""))
def availability_overridden(i: Inputs) -> DataFrame:
    w = fuel.weights_table(i.spark, {"grassland": 0.2})
    return fuel.availability(i.cells(), i.lookup(), w).groupBy("class").agg(
        F.max("availability").alias("availability"), F.count("*").alias("cells"))


def _two_sources(i: Inputs) -> tuple[DataFrame, DataFrame]:
    p = i.cells().select(*CELL, F.when(F.col("status") != "P", F.col("class")).alias("class"))
    s = i.cells().select(*CELL, (F.col("cust") % 3 + 311).cast("string").alias("class"))
    return p, s


@query("fuel_merge", "J04", sql(
    """SELECT r AS "row", c AS "col", coalesce(CASE WHEN status <> 'P' THEN class END, CAST(311 + cust % 3 AS VARCHAR)) AS class,
         CASE WHEN status <> 'P' AND class IS NOT NULL THEN 'worldcover_2021' ELSE 'clc_2018' END AS source FROM cells"""))
def fuel_merge(i: Inputs) -> DataFrame:
    p, s = _two_sources(i)
    return fuel.merge_classes(p, s, "worldcover_2021", "clc_2018")


@query("lookup_union", "U02 U04 J04", sql(
    """SELECT code, min(origin) AS origin, count(*) > 1 AS shared FROM (SELECT DISTINCT class AS code, 1 AS origin FROM cells WHERE class IS NOT NULL
       UNION ALL SELECT DISTINCT CAST(10 * (cust % 15) AS VARCHAR), 2 FROM cells) GROUP BY code"""))
def lookup_union(i: Inputs) -> DataFrame:
    a = i.cells().filter("class is not null").select(F.col("class").alias("code"), F.lit(1).alias("origin")).distinct()
    b = i.cells().select((10 * (F.col("cust") % 15)).cast("string").alias("code"), F.lit(2).alias("origin")).distinct()
    shared = fuel.shared_codes(a, b).withColumn("shared", F.lit(True))
    return fuel.union_lookups(a, b).join(shared, "code", "left").fillna(False, ["shared"])


@query("lookup_collisions", "J04", sql(
    """SELECT a.code, a.fuel_type, b.fuel_type AS other_type FROM lookup a JOIN
       (SELECT class AS code, max(CASE WHEN cust % 10 < 5 THEN 'cropland' ELSE 'shrubland' END) AS fuel_type FROM cells GROUP BY class) b
       ON a.code = b.code WHERE a.fuel_type <> b.fuel_type"""))
def lookup_collisions(i: Inputs) -> DataFrame:
    other = i.cells().groupBy(F.col("class").alias("code")).agg(
        F.max(F.when(F.col("cust") % 10 < 5, "cropland").otherwise("shrubland")).alias("fuel_type"))
    return fuel.code_collisions(i.lookup(), other)


@query("unknown_classes", "U05 S10", sql(
    "SELECT DISTINCT class AS code FROM cells WHERE class IS NOT NULL EXCEPT SELECT code FROM lookup"))
def unknown_classes(i: Inputs) -> DataFrame:
    return i.cells().filter("class is not null").select(F.col("class").alias("code")).distinct().exceptAll(i.lookup().select("code"))


@query("attach_coverage", "J10", sql(
    f"""SELECT count(class) AS classed, count(class) FILTER (metric > 0) AS covered, {rd('100.0 * count(class) FILTER (metric > 0) / count(class)')} AS pct FROM cells"""))
def attach_coverage(i: Inputs) -> DataFrame:
    extra = i.cells().select(*CELL, F.when(F.col("metric") > 0, F.col("metric")).alias("Height"))
    return fuel.attach_coverage(fuel.attach(i.cells().select(*CELL, "class"), extra, ["Height"]), "Height")


@query("class_summary", "A02 W05", sql(
    f"""SELECT class, count(*) AS cells, {rd('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct, fuel_type, burnable
        FROM cells LEFT JOIN lookup ON code = class WHERE class IS NOT NULL GROUP BY class, fuel_type, burnable"""))
def class_summary(i: Inputs) -> DataFrame:
    return fuel.class_summary(i.cells(), i.lookup())


@query("layer_summary", "A01 A03", sql(
    f"""SELECT layer, {rd('min(v)')} AS min, {rd('max(v)')} AS max, count(v) AS n_valid, {rd('100.0 * (max(w)::BIGINT * max(w) - count(v)) / (max(w)::BIGINT * max(w))')} AS pct_null
        FROM (SELECT 'grade' AS layer, grade AS v, w FROM cells UNION ALL SELECT 'holed', holed, w FROM cells) GROUP BY layer"""))
def layer_summary(i: Inputs) -> DataFrame:
    a = i.cells().select(F.lit("grade").alias("layer"), F.col("grade").alias("value"))
    b = i.cells().select(F.lit("holed").alias("layer"), F.col("holed").alias("value"))
    return algebra.layer_summary(a.unionByName(b), i.grid.ncell)


@query("minmax_layer", "M04 M02", sql(
    f"""SELECT r AS "row", c AS "col", {rd('(elev - min(elev) OVER ()) / (max(elev) OVER () - min(elev) OVER ())')} AS elev FROM cells"""))
def minmax_layer(i: Inputs) -> DataFrame:
    return algebra.minmax(i.layers(), ["elev"]).select(*CELL, "elev")


@query("vulnerability_log_inverted", "M05 M06", sql(
    f"""SELECT r AS "row", c AS "col", {rd('1 - (ln(1 + pop) - min(ln(1 + pop)) OVER ()) / (max(ln(1 + pop)) OVER () - min(ln(1 + pop)) OVER ())')} AS vulnerability FROM cells"""))
def vulnerability_log(i: Inputs) -> DataFrame:
    return algebra.vulnerability_layer(i.layers(), "pop", "log", invert=True).select(*CELL, "vulnerability")


_RANK = "SELECT r AS \"row\", c AS \"col\", {f} AS {o} FROM (SELECT *, CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 END AS rk, count({v}) OVER () AS n FROM cells)"


@query("vulnerability_percentile_rank", "W03 M03", sql(_RANK.format(f=rd("(rk - 0.5) / n"), o="vulnerability", v="holed")))
def vulnerability_rank(i: Inputs) -> DataFrame:
    return algebra.vulnerability_layer(i.layers(), "holed", "percentile_rank").select(*CELL, "vulnerability")


@query("load_weight_rank", "M17 W03", sql(_RANK.format(f=rd("coalesce((rk - 1) / (n - 1), 0.25)"), o="availability", v="holed")))
def load_weight_rank(i: Inputs) -> DataFrame:
    return algebra.load_weight(i.layers(), "holed", "percentile_rank", fill=0.25).select(*CELL, "availability")


@query("load_weight_clamped", "M17 M03", sql(
    f"""SELECT r AS "row", c AS "col", {rd('(least(greatest(pop, 5), 40) - 5) / 35.0')} AS availability FROM cells"""))
def load_weight_clamped(i: Inputs) -> DataFrame:
    return algebra.load_weight(i.layers(), "pop", "minmax", limits=(5, 40)).select(*CELL, "availability")


@query("load_weight_log", "M17", sql(
    f"""SELECT r AS "row", c AS "col", {rd('(ln(1 + elev) - min(ln(1 + elev)) OVER ()) / (max(ln(1 + elev)) OVER () - min(ln(1 + elev)) OVER ())')} AS availability FROM cells"""))
def load_weight_log(i: Inputs) -> DataFrame:
    return algebra.load_weight(i.layers(), "elev", "log").select(*CELL, "availability")


@query("stack_weighted_mean", "M12", sql(
    f"""SELECT r AS "row", c AS "col", {rd('holed * 0.7 + pop / 49.0 * 0.3')} AS vulnerability FROM cells"""))
def stack_weighted(i: Inputs) -> DataFrame:
    df = i.layers().withColumn("pop", F.col("pop") / 49)
    return algebra.weighted_stack(df, ["holed", "pop"], [0.7, 0.3]).select(*CELL, "vulnerability")


@query("stack_maximum", "M12", sql(
    f"""SELECT r AS "row", c AS "col", {rd('greatest(holed, pop / 49.0)')} AS vulnerability FROM cells"""))
def stack_maximum(i: Inputs) -> DataFrame:
    df = i.layers().withColumn("pop", F.col("pop") / 49)
    return algebra.weighted_stack(df, ["holed", "pop"], method="max").select(*CELL, "vulnerability")


_INDEX = {"product": "d * a", "min": "CASE WHEN d IS NOT NULL AND a IS NOT NULL THEN least(d, a) END",
          "mean": "d * 0.6 + a * 0.4", "geometric": "sqrt(d * a)"}


def _danger_index(method: str):
    @query(f"danger_index_{method}", "M07 M08", sql(
        f"""SELECT r AS "row", c AS "col", {rd(_INDEX[method])} AS "index" FROM (SELECT r, c, holed AS d, weight AS a FROM cells
            LEFT JOIN lookup ON code = class LEFT JOIN weights USING (fuel_type))"""))
    def build(i: Inputs) -> DataFrame:
        danger = i.cells().select(*CELL, (F.col("holed") * 100).alias("danger"))
        danger = algebra.normalise_danger(danger, "danger", "auto", role="fwi_percentile")
        have = fuel.availability(i.cells(), i.lookup(), fuel.weights_table(i.spark))
        return algebra.danger_index(danger, have, method=method, weights=(0.6, 0.4)).select(*CELL, "index")


for _m in _INDEX:
    _danger_index(_m)


@query("danger_series_minmax", "M07 M04", sql(
    f"""SELECT id, d AS date, {rd('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())')} AS value FROM series"""))
def danger_series_minmax(i: Inputs) -> DataFrame:
    return algebra.normalise_danger(i.series(), "value", "minmax").select("id", "date", "value")


@query("danger_class_effis", "M09", sql(
    """SELECT danger_class, danger_class_ord, count(*) AS days FROM (SELECT
         CASE WHEN value < 11.2 THEN 'Low' WHEN value < 21.3 THEN 'Moderate' WHEN value < 38 THEN 'High' WHEN value < 50 THEN 'Very High'
              WHEN value < 70 THEN 'Extreme' WHEN value >= 70 THEN 'Very Extreme' END AS danger_class,
         CASE WHEN value < 11.2 THEN 1 WHEN value < 21.3 THEN 2 WHEN value < 38 THEN 3 WHEN value < 50 THEN 4 WHEN value < 70 THEN 5 WHEN value >= 70 THEN 6 END AS danger_class_ord
       FROM series) GROUP BY ALL"""))
def danger_class_effis(i: Inputs) -> DataFrame:
    return classify.danger_class(i.series(), "value").groupBy("danger_class", "danger_class_ord").agg(F.count("*").alias("days"))


@query("danger_class_custom", "M09", sql(
    """SELECT id, d AS date, CASE WHEN value < 30 THEN 'calm' WHEN value < 40.2 THEN 'alert' WHEN value IS NOT NULL THEN 'closed' END AS danger_class FROM series"""))
def danger_class_custom(i: Inputs) -> DataFrame:
    got = classify.danger_class(i.series(), "value", breaks=[30, 40.2], labels=["calm", "alert", "closed"])
    return got.select("id", "date", "danger_class")


@query("risk_equal_mean", "M13", sql(
    f"""SELECT r AS "row", c AS "col", {rd('(a + b + e) / 3')} AS risk FROM (SELECT r, c, (holed - min(holed) OVER ()) / (max(holed) OVER () - min(holed) OVER ()) AS a,
        (pop - min(pop) OVER ()) / (max(pop) OVER () - min(pop) OVER ()) AS b, (elev - min(elev) OVER ()) / (max(elev) OVER () - min(elev) OVER ()) AS e FROM cells)"""))
def risk_equal(i: Inputs) -> DataFrame:
    return algebra.risk_mean(i.layers(), ["holed", "pop", "elev"]).select(*CELL, "risk")


@query("risk_weighted", "M13", sql(
    f"""SELECT r AS "row", c AS "col", {rd('holed * 0.8 + pop / 49.0 * 0.2')} AS risk FROM cells"""))
def risk_weighted(i: Inputs) -> DataFrame:
    df = i.layers().withColumn("pop", F.col("pop") / 49)
    return algebra.risk_mean(df, ["holed", "pop"], [0.8, 0.2], normalise="none").select(*CELL, "risk")


_KEYS = """sc AS (SELECT r, c, round_even((holed - min(holed) OVER ()) / (max(holed) OVER () - min(holed) OVER ()), 2) AS x,
  round_even((pop - min(pop) OVER ()) / (max(pop) OVER () - min(pop) OVER ()), 2) AS y,
  round_even((elev - min(elev) OVER ()) / (max(elev) OVER () - min(elev) OVER ()), 2) AS z FROM cells),
u AS (SELECT DISTINCT x, y, z FROM sc WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"""
_DOM = "b.x >= a.x AND b.y >= a.y AND b.z >= a.z AND (b.x > a.x OR b.y > a.y OR b.z > a.z)"


@query("risk_pareto_front", "R01 U06", sql(
    """SELECT r AS "row", c AS "col", CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN NULL ELSE coalesce(f, 0.0) END::DOUBLE AS risk
       FROM sc LEFT JOIN front USING (x, y, z)""",
    _KEYS, f"front AS (SELECT *, 1.0 AS f FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE {_DOM}))"))
def risk_pareto(i: Inputs) -> DataFrame:
    return skyline.pareto(i.layers(), ["holed", "pop", "elev"], digits=2).select(*CELL, "risk")


@query("risk_pareto_peeled", "R02", sql(
    f"""SELECT r AS "row", c AS "col", CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN NULL ELSE {rd('coalesce((3 - lev + 1) / 3.0, 0)')} END AS risk
       FROM sc LEFT JOIN (SELECT *, 1 AS lev FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3) USING (x, y, z)""",
    _KEYS, f"f1 AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE {_DOM}))",
    "u2 AS (SELECT * FROM u EXCEPT SELECT * FROM f1)", f"f2 AS (SELECT * FROM u2 a WHERE NOT EXISTS (SELECT 1 FROM u2 b WHERE {_DOM}))",
    "u3 AS (SELECT * FROM u2 EXCEPT SELECT * FROM f2)", f"f3 AS (SELECT * FROM u3 a WHERE NOT EXISTS (SELECT 1 FROM u3 b WHERE {_DOM}))"))
def risk_peeled(i: Inputs) -> DataFrame:
    return skyline.pareto(i.layers(), ["holed", "pop", "elev"], depth=3, digits=2).select(*CELL, "risk")


@query("risk_pareto_all_levels", "R02", sql(
    f"""SELECT r AS "row", c AS "col", CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN NULL ELSE {rd('(top - lev + 1) / top')} END AS risk
       FROM sc LEFT JOIN (SELECT x, y, z, max(l) AS lev FROM chain GROUP BY x, y, z) USING (x, y, z), (SELECT CAST(max(l) AS DOUBLE) AS top FROM chain)""",
    _KEYS.replace(", 2) AS", ", 1) AS"), f"chain(x, y, z, l) AS (SELECT x, y, z, 1 FROM u UNION SELECT a.x, a.y, a.z, l + 1 FROM chain b JOIN u a ON {_DOM})"))
def risk_all_levels(i: Inputs) -> DataFrame:
    return skyline.pareto(i.layers(), ["holed", "pop", "elev"], depth=math.inf, digits=1).select(*CELL, "risk")


@query("crown_fire_cells", "M14 M15", sql(
    f"""SELECT r AS "row", c AS "col", {rd('intensity')} AS intensity, {rd('i0')} AS i0, {rd('r0')} AS r0, intensity > i0 AS ignites, spread >= r0 AS active FROM crown""",
    """crown AS (SELECT *, 18000 * load * spread / 60.0 AS intensity, pow(cbh * (460 + 25.9 * fmc) / 100.0, 1.5) AS i0, 3.0 / cbd AS r0 FROM (
         SELECT r, c, class, 0.5 + elev / 500.0 AS cbh, 0.05 + holed / 4.0 AS cbd, 80.0 + pop AS fmc, 1 + grade AS load, 1 + pop / 2.0 AS spread FROM cells))"""))
def crown_fire_cells(i: Inputs) -> DataFrame:
    return _crown(i).select(*CELL, "intensity", "i0", "r0", "ignites", "active")


def _crown(i: Inputs) -> DataFrame:
    df = i.cells().select(*CELL, "class", (0.5 + F.col("elev") / 500).alias("cbh"), (0.05 + F.col("holed") / 4).alias("cbd"),
                          (80 + F.col("pop")).alias("fmc"), (1 + F.col("grade")).alias("load"), (1 + F.col("pop") / 2).alias("spread"))
    return algebra.crown_fire(algebra.fireline(df, "load", "spread"), "cbh", "cbd", "fmc", "intensity", "spread")


@query("crowning_share", "M15", sql(
    f"""SELECT class, count(i0) AS cells, {rd('avg(CAST(intensity > i0 AS INTEGER))')} AS share_ignites,
          {rd('avg(CAST(CASE WHEN NOT (intensity > i0) THEN false ELSE (intensity > i0) AND (spread >= r0) END AS INTEGER))')} AS share_active FROM crown GROUP BY class""",
    """crown AS (SELECT *, 18000 * load * spread / 60.0 AS intensity, pow(cbh * (460 + 25.9 * fmc) / 100.0, 1.5) AS i0, 3.0 / cbd AS r0 FROM (
         SELECT r, c, class, 0.5 + elev / 500.0 AS cbh, 0.05 + holed / 4.0 AS cbd, 80.0 + pop AS fmc, 1 + grade AS load, 1 + pop / 2.0 AS spread FROM cells))"""))
def crowning_share(i: Inputs) -> DataFrame:
    return algebra.crowning_share(_crown(i), "class")


@query("humidity_at_temperature", "M16", sql(
    f"""SELECT id, d AS date, {rd('least(greatest(100 * exp(17.67 * td / (243.5 + td) - 17.67 * t2 / (243.5 + t2)), 1), 100)')} AS rh2 FROM (
        SELECT *, 243.5 * g / (17.67 - g) AS td, temp - 6.5 * elev_m / 1000.0 AS t2 FROM (
        SELECT *, ln(least(greatest(rh, 0.001), 100) / 100) + 17.67 * temp / (243.5 + temp) AS g FROM weather))"""))
def humidity(i: Inputs) -> DataFrame:
    t2 = F.col("temp") - 6.5 * F.col("elev_m") / 1000
    return i.weather().select("id", "date", rh_at_temperature("temp", "rh", t2).alias("rh2"))


@query("clamped_and_significant", "M03", sql(
    f"""SELECT o_orderkey, {rd('least(greatest(o_totalprice, 2000), 400000)')} AS clamped,
          {rd('round_even(o_totalprice / pow(10.0, floor(log10(o_totalprice)) - 1), 0) * pow(10.0, floor(log10(o_totalprice)) - 1)')} AS two_digits FROM orders"""))
def clamped_and_significant(i: Inputs) -> DataFrame:
    return i.table("orders").select("o_orderkey", clamp("o_totalprice", 2000, 400000).alias("clamped"), signif("o_totalprice", 2).alias("two_digits"))


_LONG = """pm AS (SELECT p_type AS class, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_type, 'price', p_retailprice FROM part)"""


def _parts(i: Inputs) -> DataFrame:
    return i.table("part").select(F.col("p_type").alias("class"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


@query("profile_quartiles", "A14", sql(
    f"""SELECT class, metric, count(value) AS n, {rd('quantile_cont(value, 0.25)')} AS q25, {rd('quantile_cont(value, 0.5)')} AS median, {rd('quantile_cont(value, 0.75)')} AS q75
        FROM pm GROUP BY class, metric""", _LONG))
def profile_quartiles(i: Inputs) -> DataFrame:
    return profile.summarise(_parts(i), ["size", "price"])


@query("profile_explained", "A15", sql(
    f"""SELECT metric, sum(n)::BIGINT AS n, count(*) AS n_classes, {rd('1 - sum(n * v) / max(tot)')} AS explained FROM (
        SELECT metric, class, count(*) AS n, var_pop(value) AS v FROM pm GROUP BY metric, class) JOIN (SELECT metric, count(*) * var_pop(value) AS tot FROM pm GROUP BY metric) USING (metric) GROUP BY metric""", _LONG))
def profile_explained(i: Inputs) -> DataFrame:
    return profile.explained(_parts(i), ["size", "price"])


@query("profile_separability", "A16", sql(
    f"""SELECT metric, n_pos AS n_class, n_neg AS n_other, CASE WHEN least(n_pos, n_neg) >= 30 THEN {rd('auc')} END AS separability FROM {_auc_sql('sc', 'metric')}""",
    _LONG, "sc AS (SELECT metric, value AS v, CAST(class = 'ECONOMY' AS INTEGER) AS p FROM pm)"))
def profile_separability(i: Inputs) -> DataFrame:
    return profile.separability(_parts(i), ["size", "price"], "ECONOMY")


@query("quantiles_by_class", "A04 A14", sql(
    f"""SELECT class, CAST(p AS DOUBLE) AS prob, {rd('quantile_cont(elev, p)')} AS q FROM cells, (VALUES (0.0), (0.1), (0.5), (0.98), (1.0)) t(p)
        WHERE class IS NOT NULL GROUP BY class, p""".replace("quantile_cont(elev, p)", "CASE p WHEN 0.0 THEN quantile_cont(elev, 0.0) WHEN 0.1 THEN quantile_cont(elev, 0.1) WHEN 0.5 THEN quantile_cont(elev, 0.5) WHEN 0.98 THEN quantile_cont(elev, 0.98) ELSE quantile_cont(elev, 1.0) END")))
def quantiles_by_class(i: Inputs) -> DataFrame:
    return rank.quantiles(i.cells().filter("class is not null"), "elev", [0, 0.1, 0.5, 0.98, 1], ["class"]).drop("n")


@query("transect_plan", "M21", sql(
    """SELECT segment, count(*) AS assets, sum(CASE WHEN x - 5000 * segment >= 0 AND x + 5000 * segment <= w * 25 AND y - 5000 * segment >= 0 AND y + 5000 * segment <= w * 25
         THEN 1 ELSE 0 END)::BIGINT AS wholly_mapped FROM stations, dims, (VALUES (1), (2), (3)) t(segment) GROUP BY segment"""))
def transect_plan(i: Inputs) -> DataFrame:
    g = i.grid
    ends = directional_defaults(i.spark).agg(F.collect_list(F.struct("segment", (F.col("segment") * F.col("length_m")).alias("reach"))).alias("e"))
    each = i.stations().withColumn("e", ends.scalar()).select("x", "y", F.inline("e"))
    r = F.col("reach")
    inside = (F.col("x") - r >= g.xmin) & (F.col("x") + r <= g.xmax) & (F.col("y") - r >= g.ymin) & (F.col("y") + r <= g.ymax)
    return each.groupBy("segment").agg(F.count("*").alias("assets"), F.count_if(inside).alias("wholly_mapped"))


@query("zone_raster", "J13", sql(
    """SELECT coalesce(CAST(m AS BIGINT), -1) AS zone, count(*) AS cells FROM cells LEFT JOIN (SELECT r, c, max(fire_id) AS m FROM fire_cells GROUP BY r, c) USING (r, c) GROUP BY 1"""))
def zone_raster(i: Inputs) -> DataFrame:
    zones = raster.burn_attribute(i.fires(), i.grid, "fire_id", []).select(*CELL, F.col("fire_id").alias("zone"))
    return i.cells().select(*CELL).join(zones, CELL, "left").groupBy(F.coalesce("zone", F.lit(-1)).alias("zone")).agg(F.count("*").alias("cells"))


@query("fuel_source_from_polygons", "X02 S08 S09", sql(
    """SELECT fuel_type, burnable, count(*) AS cells FROM (
         SELECT d.code FROM (SELECT r, c FROM (SELECT unnest(range(0, w)) AS r FROM dims) CROSS JOIN (SELECT unnest(range(0, w)) AS c FROM dims)) g
         LEFT JOIN (SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(311 + max(fire_id) % 3 AS VARCHAR) AS code FROM full_cells GROUP BY r, c) d USING (r, c))
       LEFT JOIN (VALUES ('311', 'broadleaf_closed', 1), ('312', 'conifer_closed', 1), ('313', 'mixed_closed', 1)) k(code, fuel_type, burnable) USING (code)
       GROUP BY fuel_type, burnable""",
    """full_cells AS (SELECT f.fire_id, r, c FROM (SELECT fire_id, (c0 + 6) * 25.0 AS x, (w - r0 - 6) * 25.0 AS y, side * 25 / 2.0 + 5 AS h, w,
         unnest(range(r0 - 6, r0 + 18)) AS r, c0 FROM fires) f, LATERAL (SELECT unnest(range(c0 - 6, c0 + 18)) AS c)
       WHERE abs((c + 0.5) * 25 - x) + abs((w - r - 0.5) * 25 - y) < h AND r >= 0 AND r < w AND c >= 0 AND c < w)"""))
def fuel_source_from_polygons(i: Inputs) -> DataFrame:
    from emberline.sources.lookup import builtin_lookup

    shapes = i.diamonds().withColumn("code", (311 + F.col("fire_id") % 3).cast("string"))
    made = fuel.FuelSource.from_polygons(shapes, i.grid, "clc_2018", builtin_lookup(i.spark, "clc"), "code", "fire_id", vintage=2018)
    typed = fuel.burnable(fuel.fuel_type(made.categorical(), made.lookup), made.lookup)
    return typed.groupBy("fuel_type", "burnable").agg(F.count("*").alias("cells"))
