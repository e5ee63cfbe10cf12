"""Inputs of the registered queries, derived from the star-schema tables.

Every order is a grid cell, every supplier a weather station and a fire, every line
item an observation, so all inputs grow with the tables.  The grid is square and its
side follows the number of orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.grid import CELL, GridSpec
from emberline.operators.raster import rectangle
from emberline.sources.lookup import builtin_lookup

RES = 25.0
#: Cells of one part where bands are dealt by cell; a cell has a few lines.
PART_CELLS = 1 << 16


class Inputs:
    """Derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._tables = spark, sf_dir, {}
        top = self.table("orders").agg(F.max("o_orderkey")).first()[0]
        self.side = math.ceil(math.sqrt(top + 1))
        self.grid = GridSpec(0.0, self.side * RES, RES, self.side, self.side)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def _at(self, key: str):
        return [F.expr(f"cast({key} div {self.side} as int)").alias("row"), F.expr(f"cast({key} % {self.side} as int)").alias("col")]

    def cells(self) -> DataFrame:
        """One cell per order: class with a few holes and unknown codes, grade, elevation, assets."""
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        code = (10 * (1 + F.col("o_custkey") % 10)).cast("string")
        o = self.table("orders").withColumn("cents", cents)
        return o.select(
            *self._at("o_orderkey"),
            F.when(F.col("o_totalprice") > 497500, None).when(F.col("o_totalprice") > 496500, "999").otherwise(code).alias("class"),
            (F.col("cents") % 101 / 100).alias("grade"),
            F.when(F.col("o_totalprice") <= 497500, F.col("cents") % 101 / 100).alias("holed"),
            (100 + F.expr("cents div 1000") % 900).cast("double").alias("elev"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("asset"),
            (F.col("cents") % 50).cast("double").alias("pop"),
            F.when(F.col("cents") % 50 > 2, F.col("cents") % 50).otherwise(-1).cast("double").alias("metric"),
            F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))

    def lookup(self) -> DataFrame:
        return builtin_lookup(self.spark, "worldcover")

    def fires(self) -> DataFrame:
        """One square per supplier."""
        s, span = self.side, self.side - 12
        f = self.table("supplier").select(
            F.col("s_suppkey").alias("fire_id"), (1995 + F.col("s_nationkey") % 7).cast("int").alias("fire_year"),
            (F.col("s_suppkey") * 7919 % span).cast("int").alias("r0"), (F.col("s_suppkey") * 104729 % span).cast("int").alias("c0"),
            (2 + F.col("s_nationkey") % 9).cast("int").alias("side"), F.floor(F.abs("s_acctbal")).cast("double").alias("area_ha"))
        f = f.withColumns({"xmin": F.col("c0") * RES, "xmax": (F.col("c0") + F.col("side")) * RES,
                           "ymin": (s - F.col("r0") - F.col("side")) * RES, "ymax": (s - F.col("r0")) * RES})
        return f.withColumn("rings", rectangle("xmin", "ymin", "xmax", "ymax"))

    def diamonds(self) -> DataFrame:
        """One diamond per supplier with a land-cover code; overlaps occur."""
        f = self.fires().select("fire_id", "fire_year", ((F.col("c0") + 6) * RES).alias("x"), ((self.side - F.col("r0") - 6) * RES).alias("y"),
                                (F.col("side") * RES / 2 + 5).alias("h"), (100 + F.col("fire_id") % 7).cast("string").alias("code_18"))
        pts = [(F.lit(0), F.col("h")), (F.col("h"), F.lit(0)), (F.lit(0), -F.col("h")), (-F.col("h"), F.lit(0))]
        ring = F.array(F.array(*[F.struct((F.col("x") + a).cast("double").alias("x"), (F.col("y") + b).cast("double").alias("y")) for a, b in pts]))
        return f.withColumn("rings", ring)

    def weather(self) -> DataFrame:
        """One row per supplier and ship date with weather of that day."""
        d = self.table("lineitem").groupBy(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date")).agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("s"), F.sum("l_orderkey").alias("k"))
        return d.select(
            "id", "date", F.year("date").alias("yr"), F.month("date").alias("mon"), F.dayofmonth("date").alias("day"),
            (60 - 2.5 * (F.col("id") % 40)).alias("lat"), (2.5 * F.expr("id div 40")).alias("long"),
            ((50 + F.col("s") % 300) / 10).alias("temp"), (20 + F.expr("s div 7") % 70).cast("double").alias("rh"),
            (F.expr("s div 11") % 40).cast("double").alias("ws"),
            F.when(F.col("k") % 5 == 0, F.expr("k div 5") % 20).otherwise(0).cast("double").alias("prec"),
            (100 + F.col("id") * 37 % 900).cast("double").alias("elev_m"))

    def stations(self) -> DataFrame:
        """Stations on the grid, at a cell centre each."""
        f = self.fires()
        return f.select(F.col("fire_id").alias("id"), F.col("fire_id").alias("ord"), ((F.col("c0") + 0.5) * RES).alias("x"),
                        ((self.side - F.col("r0") - 0.5) * RES).alias("y"), (100 + F.col("fire_id") * 37 % 900).cast("double").alias("elev_m"))

    def lattice(self) -> DataFrame:
        """Station coordinates alone."""
        return self.table("lineitem").select(F.col("l_suppkey").alias("id")).distinct().select(
            (60 - 2.5 * (F.col("id") % 40)).alias("lat"), (2.5 * F.expr("id div 40")).alias("long"))

    def series(self) -> DataFrame:
        """Dated danger per station, with the nation of the supplier as its zone; one nation is left unzoned."""
        z = self.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") != 24, F.col("s_nationkey")).alias("zone"))
        return self.weather().select("id", "date", F.when(F.col("ws") > 0, F.col("temp") * 2).alias("value")).join(z, "id")

    def hourly(self) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long")
        h = self.table("events").groupBy(F.col("user_id").alias("id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(cents).alias("s"))
        return h.select("id", "ts", (F.col("s") % 300 / 10).alias("temp"), (20 + F.expr("s div 7") % 70).cast("double").alias("rh"),
                        (F.expr("s div 11") % 40).cast("double").alias("ws"), (F.col("s") / 100).alias("prec"))

    def burnt_raw(self) -> DataFrame:
        """Fire records as text in two date formats, some without a readable area."""
        day = F.col("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("fid"),
            F.when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("FireDate"),
            F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise((F.col("o_custkey") + 0.5).cast("string")).alias("AREA_HA"))

    def catalog(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        return self.table("orders").select(F.col("o_orderkey").alias("scene"), F.to_date("o_orderdate").alias("date"),
                                           F.col("o_orderpriority").alias("tile"), (cents % 10001 / 100).alias("cloud"))

    def bands(self) -> DataFrame:
        """Two bands per scene (line number), tile (supplier) and cell (order).

        Rows are dealt by cell once, and every later step by cell, scene or tile stays there.  The number of parts follows the
        grid, so a task holds about ``PART_CELLS`` cells whatever its size, and nothing is aggregated before rows are dealt:
        lines of a cell lie in one part of the table or another, and a table of half a scan would save nothing.
        """
        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(self.grid.ncell / PART_CELLS))
        lines = self.table("lineitem").select(
            F.col("l_linenumber").alias("scene"), F.col("l_suppkey").alias("tile"), *self._at("l_orderkey"), "l_extendedprice", "l_quantity")
        return lines.repartition(parts, *CELL).groupBy("scene", "tile", *CELL).agg(
            F.max("l_extendedprice").alias("nir"), F.max(F.col("l_quantity") * 1000).alias("swir"))

    def survey(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_brand").alias("dep"), F.col("p_size").alias("pva"),
            F.expr("date_add(date'2005-01-01', cast(p_partkey % 5000 as int))").alias("date_vol"), F.col("p_retailprice").alias("area"))

    def tile_index(self) -> DataFrame:
        """One square tile per part."""
        span = self.side - 8
        return self.table("part").select(
            F.col("p_partkey").alias("name"), (F.col("p_partkey") * 7919 % span * RES).cast("double").alias("xmin"),
            (F.col("p_partkey") * 104729 % span * RES).cast("double").alias("ymin"),
            F.concat((2014 + F.col("p_size") % 6).cast("string"), F.lit("-06-01")).alias("timestamp"), F.col("p_brand").alias("block")
        ).withColumns({"xmax": F.col("xmin") + 4 * RES, "ymax": F.col("ymin") + 4 * RES})

    def source_log(self) -> DataFrame:
        """Source records of many runs: one per document, its reviewer label as vintage."""
        return self.table("documents").join(self.table("labels"), "doc_id", "left").select(
            F.concat("lang", F.lit("/"), "source").alias("dataset"), F.col("doc_id").alias("seq"),
            F.when(F.col("n_chars") % 3 == 0, "CC-BY-NC-4.0").when(F.col("n_chars") % 3 == 1, "CC-BY-4.0").alias("licence"),
            F.col("lang").alias("licence_from"), (2010 + F.col("quality")).cast("int").alias("vintage"), F.col("lang").alias("run"))

    def scored(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id").select(
            F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("hit"), "lang")

    def burnt(self) -> DataFrame:
        from emberline.operators.validate import burnt_cells

        return burnt_cells(self.fires(), self.grid, "fire_id")

    def layers(self) -> DataFrame:
        """Two raw dimensions on one grid."""
        return self.cells().select(*CELL, F.col("pop").alias("pop"), F.col("elev").alias("elev"), "grade", "metric", "holed")


# The same inputs as SQL, for the second engine.
SQL = """
dims AS (SELECT CAST(ceil(sqrt(max(o_orderkey) + 1)) AS INTEGER) AS w FROM orders),
o1 AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
cells AS (
  SELECT CAST(o_orderkey // w AS INTEGER) AS r, CAST(o_orderkey % w AS INTEGER) AS c,
    CASE WHEN o_totalprice > 497500 THEN NULL WHEN o_totalprice > 496500 THEN '999'
         ELSE CAST(10 * (1 + o_custkey % 10) AS VARCHAR) END AS class,
    (cents % 101) / 100.0 AS grade, CASE WHEN o_totalprice <= 497500 THEN (cents % 101) / 100.0 END AS holed,
    CAST(100 + (cents // 1000) % 900 AS DOUBLE) AS elev, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS asset,
    CAST(cents % 50 AS DOUBLE) AS pop, CAST(CASE WHEN cents % 50 > 2 THEN cents % 50 ELSE -1 END AS DOUBLE) AS metric,
    o_orderstatus AS status, o_custkey AS cust, w
  FROM o1, dims),
lookup(code, fuel_type, burnable) AS (VALUES ('10','broadleaf_closed',true),('20','shrubland',true),('30','grassland',true),
  ('90','grassland',true),('40','cropland',false),('50','non_fuel',false),('70','non_fuel',false),('80','non_fuel',false),
  ('95','non_fuel',false),('60','sparse_vegetation',true),('100','sparse_vegetation',true)),
weights(fuel_type, weight) AS (VALUES ('sclerophyll_closed',0.95),('broadleaf_closed',0.6),('conifer_closed',0.95),
  ('mixed_closed',0.8),('broadleaf_open',0.65),('conifer_open',0.9),('mixed_open',0.8),('poplar_plantation',0.3),
  ('unstocked',0.6),('shrubland',1.0),('transitional_shrub',0.9),('grassland',0.7),('agroforestry',0.5),
  ('mosaic_agri_natural',0.35),('sparse_vegetation',0.3),('burnt_regrowth',0.7),('urban_vegetation',0.25),
  ('cropland',0.0),('non_fuel',0.0)),
fires AS (
  SELECT s_suppkey AS fire_id, CAST(1995 + s_nationkey % 7 AS INTEGER) AS fire_year, CAST(s_suppkey * 7919 % (w - 12) AS INTEGER) AS r0,
    CAST(s_suppkey * 104729 % (w - 12) AS INTEGER) AS c0, CAST(2 + s_nationkey % 9 AS INTEGER) AS side,
    CAST(floor(abs(s_acctbal)) AS DOUBLE) AS area_ha, w FROM supplier, dims),
fire_cells AS (
  SELECT fire_id, r, c FROM (SELECT fire_id, c0, side, unnest(range(r0, r0 + side)) AS r FROM fires), LATERAL (SELECT unnest(range(c0, c0 + side)) AS c)),
burnt AS (SELECT DISTINCT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM fire_cells),
diamond_cells AS (
  SELECT f.fire_id, cells.r, cells.c FROM (SELECT fire_id, (c0 + 6) * 25.0 AS x, (w - r0 - 6) * 25.0 AS y, side * 25 / 2.0 + 5 AS h FROM fires) f
  JOIN cells ON abs((cells.c + 0.5) * 25 - f.x) + abs((w - cells.r - 0.5) * 25 - f.y) < f.h),
daily AS (
  SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS s, sum(l_orderkey)::BIGINT AS k
  FROM lineitem GROUP BY 1, 2),
weather AS (
  SELECT id, d, CAST(year(d) AS INTEGER) AS yr, CAST(month(d) AS INTEGER) AS mon, CAST(day(d) AS INTEGER) AS day,
    60 - 2.5 * (id % 40) AS lat, 2.5 * (id // 40) AS long, (50 + s % 300) / 10.0 AS temp, CAST(20 + (s // 7) % 70 AS DOUBLE) AS rh,
    CAST((s // 11) % 40 AS DOUBLE) AS ws, CAST(CASE WHEN k % 5 = 0 THEN (k // 5) % 20 ELSE 0 END AS DOUBLE) AS prec,
    CAST(100 + id * 37 % 900 AS DOUBLE) AS elev_m
  FROM daily),
stations AS (SELECT fire_id AS id, (c0 + 0.5) * 25 AS x, (w - r0 - 0.5) * 25 AS y, CAST(100 + fire_id * 37 % 900 AS DOUBLE) AS elev_m FROM fires),
series AS (
  SELECT id, d, CASE WHEN ws > 0 THEN temp * 2 END AS value, CASE WHEN s_nationkey <> 24 THEN s_nationkey END AS zone
  FROM weather JOIN supplier ON s_suppkey = id),
hourly AS (
  SELECT id, ts, (s % 300) / 10.0 AS temp, CAST(20 + (s // 7) % 70 AS DOUBLE) AS rh, CAST((s // 11) % 40 AS DOUBLE) AS ws, s / 100.0 AS prec
  FROM (SELECT user_id AS id, date_trunc('hour', ts) AS ts, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS s FROM events GROUP BY 1, 2)),
catalog AS (
  SELECT o_orderkey AS scene, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS tile, (cents % 10001) / 100.0 AS cloud FROM o1),
bands AS (
  SELECT scene, tile, CAST(k // w AS INTEGER) AS r, CAST(k % w AS INTEGER) AS c, nir, swir FROM (
    SELECT l_linenumber AS scene, l_suppkey AS tile, l_orderkey AS k, max(l_extendedprice) AS nir, max(l_quantity * 1000) AS swir
    FROM lineitem GROUP BY 1, 2, 3), dims),
survey AS (
  SELECT p_brand AS dep, p_size AS pva, DATE '2005-01-01' + CAST(p_partkey % 5000 AS INTEGER) AS date_vol, p_retailprice AS area FROM part),
tile_index AS (
  SELECT *, xmin + 100 AS xmax, ymin + 100 AS ymax FROM (
    SELECT p_partkey AS name, CAST(p_partkey * 7919 % (w - 8) * 25 AS DOUBLE) AS xmin, CAST(p_partkey * 104729 % (w - 8) * 25 AS DOUBLE) AS ymin,
      CAST(2014 + p_size % 6 AS VARCHAR) || '-06-01' AS timestamp, p_brand AS block FROM part, dims)),
source_log AS (
  SELECT lang || '/' || source AS dataset, d.doc_id AS seq, CASE WHEN n_chars % 3 = 0 THEN 'CC-BY-NC-4.0' WHEN n_chars % 3 = 1 THEN 'CC-BY-4.0' END AS licence,
    lang AS licence_from, CAST(2010 + quality AS INTEGER) AS vintage, lang AS run FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
scored AS (SELECT CAST(n_chars AS DOUBLE) AS score, toxic = 1 AS hit, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
"""


def sql(body: str, *ctes: str) -> str:
    """A query over the derived inputs, with further named parts before its body."""
    parts = ",\n".join([SQL.strip(), *[c.strip() for c in ctes]])
    return f"WITH RECURSIVE {parts}\n{body.strip()}"


def rd(expr: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
