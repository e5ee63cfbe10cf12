"""Queries of the neighbourhood, raster and component operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.grid import CELL, GridSpec
from emberline.operators import components, directional, focal, raster, terrain, validate
from emberline.operators.rank import auc
from emberline.plans.inputs import RES, Inputs, rd, sql
from emberline.plans.registry import query


def _ring(radius: float, res: float = 25.0, name: str = "ring") -> str:
    n = int(radius // res)
    return (f"{name} AS (SELECT dy, dx FROM range(-{n}, {n + 1}) a(dy), range(-{n}, {n + 1}) b(dx) "
            f"WHERE sqrt(dy * dy + dx * dx) * {res} >= {res} AND sqrt(dy * dy + dx * dx) * {res} <= {radius})")


def _focal(value: str, ring: str = "ring", src: str = "cells", name: str = "foc") -> str:
    return (f"{name} AS (SELECT t.r, t.c, sum(s.v) AS s, count(s.v) AS n FROM (SELECT r, c FROM cells) t CROSS JOIN {ring} "
            f"LEFT JOIN (SELECT r, c, {value} AS v FROM {src}) s ON s.r = t.r + dy AND s.c = t.c + dx GROUP BY t.r, t.c)")


BURNABLE = ("fuel AS (SELECT r, c, class, CAST(burnable AS INTEGER) AS burnable FROM cells LEFT JOIN lookup ON code = class)")


def burnable_cells(i: Inputs) -> DataFrame:
    from emberline.operators.fuel import burnable

    return burnable(i.cells().select(*CELL, "class", "asset", "elev", "grade"), i.lookup())


@query("exposure_100m", "N03 N01", sql(
    f"SELECT r AS \"row\", c AS \"col\", CASE WHEN n = 48 THEN {rd('s / 48.0')} END AS exposure FROM foc",
    BURNABLE, _ring(100), _focal("burnable", src="fuel")))
def exposure_100m(i: Inputs) -> DataFrame:
    return focal.exposure(burnable_cells(i), i.grid, "burnable", kind="ember_short").select(*CELL, "exposure")


@query("exposure_prefix_sums", "N03", sql(
    f"SELECT r AS \"row\", c AS \"col\", CASE WHEN n = 48 THEN {rd('s / 48.0')} END AS exposure FROM foc",
    _ring(100), _focal("holed")))
def exposure_prefix(i: Inputs) -> DataFrame:
    return focal.exposure(i.cells(), i.grid, "holed", 100, strategy="prefix").select(*CELL, "exposure")


@query("exposure_offsets", "N03", sql(
    f"SELECT r AS \"row\", c AS \"col\", CASE WHEN n = 28 THEN {rd('s / 28.0')} END AS exposure FROM foc",
    _ring(75), _focal("holed")))
def exposure_offsets(i: Inputs) -> DataFrame:
    return focal.exposure(i.cells(), i.grid, "holed", 75, strategy="offsets").select(*CELL, "exposure")


@query("exposure_500m_known_cells", "N03", sql(
    f"SELECT r AS \"row\", c AS \"col\", {rd('coalesce(s, 0) / 1256.0')} AS exposure FROM foc", _ring(500), _focal("holed")))
def exposure_500m(i: Inputs) -> DataFrame:
    return focal.exposure(i.cells(), i.grid, "holed", 500, na_rm=True).select(*CELL, "exposure")


@query("exposure_no_burn", "M10", sql(
    f"""SELECT foc.r AS "row", foc.c AS "col", CASE WHEN n = 48 AND class IS DISTINCT FROM '80' THEN {rd('s / 48.0')} END AS exposure
        FROM foc JOIN cells USING (r, c)""", _ring(100), _focal("grade")))
def exposure_no_burn(i: Inputs) -> DataFrame:
    water = i.cells().select(*CELL, F.when(F.col("class") == "80", 1).alias("no_burn"))
    return focal.exposure(i.cells(), i.grid, "grade", 100, no_burn=water).select(*CELL, "exposure")


@query("exposure_trimmed", "M11", sql(
    f"""SELECT foc.r AS "row", foc.c AS "col", CASE WHEN n = 48 THEN {rd('s / 48.0')} END AS exposure
        FROM foc JOIN burnt USING (r, c)""", _ring(100), _focal("grade")))
def exposure_trimmed(i: Inputs) -> DataFrame:
    made = focal.exposure(i.cells(), i.grid, "grade", 100).select(*CELL, "exposure")
    return raster.trim(made, i.grid, i.fires(), "fire_id")


@query("exposure_by_process", "M21 N03", sql(
    """SELECT 'radiant' AS type, r10.cells, r10.mean AS mean_exposure FROM r10
       UNION ALL SELECT 'ember_short', r20.cells, r20.mean FROM r20""",
    _ring(30, 10, "ra"), _ring(100, 10, "rb"), _focal("grade", "ra", name="fa"), _focal("grade", "rb", name="fb"),
    f"r10 AS (SELECT count(*) AS cells, {rd('avg(s / 28.0)')} AS mean FROM fa WHERE n = 28)",
    f"r20 AS (SELECT count(*) AS cells, {rd('avg(s / 316.0)')} AS mean FROM fb WHERE n = 316)"))
def exposure_by_process(i: Inputs) -> DataFrame:
    from emberline.functions.constants import exposure_radii

    grid = replace(i.grid, res=10.0, ymax=i.side * 10.0)
    radii = [30.0, 100.0]
    swept = focal.exposure_sweep(i.cells(), grid, "grade", radii).filter(F.col("exposure").isNotNull())
    got = swept.groupBy("radius").agg(F.count("*").alias("cells"), F.avg("exposure").alias("mean_exposure"))
    kinds = exposure_radii(i.spark)
    return got.join(kinds, got["radius"] == kinds["max_m"]).select("type", "cells", "mean_exposure")


_SECTOR = """sect AS (SELECT dy, dx, CAST(floor(((degrees(atan2(dx, -dy)) + 720 + 22.5) % 360) / 45) AS INTEGER) AS k FROM ring),
cnt AS (SELECT k, count(*) AS m FROM sect GROUP BY k),
sec AS (SELECT t.r, t.c, k, sum(s.v) AS s, count(s.v) AS n FROM (SELECT r, c FROM cells) t CROSS JOIN sect
  LEFT JOIN (SELECT r, c, holed AS v FROM cells) s ON s.r = t.r + dy AND s.c = t.c + dx GROUP BY ALL)"""


@query("exposure_wind", "N05 N06", sql(
    f"""SELECT r AS "row", c AS "col", CASE WHEN bool_and(n = m) THEN {rd('least(1, greatest(0, sum(s / m * a)))')} END AS exposure
        FROM sec JOIN cnt USING (k) JOIN alpha USING (k) GROUP BY r, c""", _ring(100), _SECTOR,
    """raw AS (SELECT k, m / 48.0 * exp(1.5 * cos(radians(k * 45 - 300))) AS w FROM cnt),
       alpha AS (SELECT k, w / (SELECT sum(w) FROM raw) AS a FROM raw)"""))
def exposure_wind(i: Inputs) -> DataFrame:
    got = focal.exposure_directional_weighted(i.cells(), i.grid, "holed", 100, wind=300, kappa_wind=1.5)
    return got.select(*CELL, "exposure")


_HORN = """z AS (SELECT r, c, elev AS z FROM cells),
nb AS (SELECT t.r, t.c, t.z, max(CASE WHEN dy = -1 AND dx = -1 THEN s.z END) AS a, max(CASE WHEN dy = -1 AND dx = 0 THEN s.z END) AS b,
  max(CASE WHEN dy = -1 AND dx = 1 THEN s.z END) AS d, max(CASE WHEN dy = 0 AND dx = -1 THEN s.z END) AS e,
  max(CASE WHEN dy = 0 AND dx = 1 THEN s.z END) AS f, max(CASE WHEN dy = 1 AND dx = -1 THEN s.z END) AS g,
  max(CASE WHEN dy = 1 AND dx = 0 THEN s.z END) AS h, max(CASE WHEN dy = 1 AND dx = 1 THEN s.z END) AS i, count(s.z) AS n
  FROM z t CROSS JOIN (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0)
  LEFT JOIN z s ON s.r = t.r + dy AND s.c = t.c + dx GROUP BY t.r, t.c, t.z),
grad AS (SELECT r, c, CASE WHEN n = 8 THEN (d + 2 * f + i - a - 2 * e - g) / 200.0 END AS gx,
  CASE WHEN n = 8 THEN (a + 2 * b + d - g - 2 * h - i) / 200.0 END AS gy FROM nb),
terr AS (SELECT r, c, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope,
  CASE WHEN gx <> 0 OR gy <> 0 THEN (degrees(atan2(-gx, -gy)) + 360) % 360 END AS aspect FROM grad)"""


@query("exposure_wind_slope", "N06", sql(
    f"""SELECT r AS "row", c AS "col", CASE WHEN bool_and(n = m) AND min(slope) IS NOT NULL
          THEN {rd('least(1, greatest(0, sum(s / m * w) / sum(w)))')} END AS exposure
        FROM (SELECT sec.r, sec.c, sec.s, sec.n, cnt.m, slope, m / 48.0 * exp(1.5 * cos(radians(k * 45 - 300)))
                * CASE WHEN aspect IS NULL THEN 1 ELSE exp(0.8 * tan(radians(slope)) * cos(radians(k * 45 - aspect))) END AS w
              FROM sec JOIN cnt USING (k) JOIN terr ON terr.r = sec.r AND terr.c = sec.c) GROUP BY r, c""",
    _ring(100), _SECTOR, _HORN))
def exposure_wind_slope(i: Inputs) -> DataFrame:
    got = focal.exposure_directional_weighted(
        i.cells(), i.grid, "holed", 100, wind=300, kappa_wind=1.5, dem="elev", kappa_slope=0.8)
    return got.select(*CELL, "exposure")


@query("slope_aspect", "N09", sql(
    f"SELECT r AS \"row\", c AS \"col\", {rd('slope')} AS slope, {rd('aspect')} AS aspect FROM terr", _HORN))
def slope_aspect(i: Inputs) -> DataFrame:
    return terrain.slope_aspect(i.cells(), i.grid, "elev").select(*CELL, "slope", "aspect")


@query("curvature", "N08", sql(
    f"""SELECT r AS "row", c AS "col", {rd('k / (2 * greatest(max(abs(k)) OVER (), 0.001))')} AS curvature
        FROM (SELECT r, c, CASE WHEN n = 8 THEN (z - s / 8) / 200.0 END AS k FROM nb)""",
    """z AS (SELECT r, c, elev AS z FROM cells),
       nb AS (SELECT t.r, t.c, t.z, sum(s.z) AS s, count(s.z) AS n FROM z t
         CROSS JOIN (SELECT dy, dx FROM (VALUES (-4), (0), (4)) a(dy), (VALUES (-4), (0), (4)) b(dx) WHERE dy <> 0 OR dx <> 0)
         LEFT JOIN z s ON s.r = t.r + dy AND s.c = t.c + dx GROUP BY t.r, t.c, t.z)"""))
def curvature(i: Inputs) -> DataFrame:
    return terrain.curvature(i.cells(), i.grid, "elev", 100).select(*CELL, "curvature")


_NEAR = """disc AS (SELECT dy, dx FROM range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE sqrt(dy * dy + dx * dx) * 25 <= 100),
flag AS (SELECT r, c, asset, CASE WHEN grade > 0.9 THEN 1 ELSE 0 END AS f FROM cells),
near AS (SELECT t.r, t.c, max(t.asset) AS a, max(t.f) AS f, coalesce(max(s.asset), 0) AS an, coalesce(max(s.f), 0) AS fn
  FROM flag t CROSS JOIN disc LEFT JOIN flag s ON s.r = t.r + dy AND s.c = t.c + dx GROUP BY t.r, t.c)"""
_SIDES = {"assets": "a = 1 AND fn = 1", "fuel": "f = 1 AND an = 1", "both": "(a = 1 AND fn = 1) OR (f = 1 AND an = 1)"}


def _wui(side: str):
    @query(f"interface_{side}", "N07 N02", sql(
        f"SELECT r AS \"row\", c AS \"col\", CAST({_SIDES[side]} AS INTEGER) AS wui FROM near", _NEAR))
    def build(i: Inputs) -> DataFrame:
        cells = i.cells().withColumn("fuel", (F.col("grade") > 0.9).cast("int"))
        return focal.interface(cells, i.grid, "asset", "fuel", 100, side=side)


for _s in _SIDES:
    _wui(_s)


@query("interface_area", "N07", sql(
    f"SELECT sum(CAST({_SIDES['assets']} AS INTEGER))::BIGINT AS cells, {rd('sum(CAST(' + _SIDES['assets'] + ' AS INTEGER)) * 0.0625')} AS area_ha FROM near", _NEAR))
def interface_area(i: Inputs) -> DataFrame:
    cells = i.cells().withColumn("fuel", (F.col("grade") > 0.9).cast("int"))
    n = F.sum("wui")
    return focal.interface(cells, i.grid, "asset", "fuel", 100).agg(n.alias("cells"), (n * F.lit(i.grid.cell_ha)).alias("area_ha"))


_COMP = """gap AS (SELECT r, c, CAST(r AS BIGINT) * w + c AS id FROM cells WHERE elev > 980),
reach AS (SELECT id, id AS other FROM gap UNION
  SELECT reach.id, b.r::BIGINT * (SELECT w FROM dims) + b.c FROM reach JOIN gap a ON a.id = reach.other
  JOIN gap b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
comp AS (SELECT gap.r, gap.c, min(other) AS component, count(*) AS size FROM reach JOIN gap USING (id) GROUP BY gap.r, gap.c)"""


def _gappy(i: Inputs) -> DataFrame:
    return i.cells().select(*CELL, F.when(F.col("elev") <= 980, F.col("class")).alias("class"), "elev")


@query("null_components", "N10", sql('SELECT r AS "row", c AS "col", component, size FROM comp', _COMP))
def null_components(i: Inputs) -> DataFrame:
    shaped = i.cells().select(*CELL, F.when(F.col("elev") <= 980, F.col("elev")).alias("v"))
    return components.null_components(shaped, i.grid, "v", side=32)


@query("gap_bound", "N04", sql(
    """SELECT count(*) AS null_cells, count(DISTINCT component) AS gaps,
         least(count(DISTINCT component) * 51, max((SELECT w FROM dims)::BIGINT * (SELECT w FROM dims))) AS bound_cells FROM comp""", _COMP))
def gap_bound(i: Inputs) -> DataFrame:
    shaped = i.cells().select(*CELL, F.when(F.col("elev") <= 980, F.col("elev")).alias("v"))
    return focal.gap_bound(components.null_components(shaped, i.grid, "v"), i.grid, 100)


def _pass(n: int) -> str:
    """One 3x3 modal pass over the small gaps still unknown, lowest class on ties."""
    src = f"p{n - 1}"
    return f"""p{n} AS (SELECT t.r, t.c, coalesce(t.k, best.k) AS k, t.small FROM {src} t LEFT JOIN (
  SELECT r, c, arg_min(k, struct_pack(a := -m, b := k)) AS k FROM (
    SELECT t.r, t.c, s.k, count(*) AS m FROM {src} t JOIN {src} s ON s.r BETWEEN t.r - 1 AND t.r + 1 AND s.c BETWEEN t.c - 1 AND t.c + 1
    WHERE t.k IS NULL AND t.small AND s.k IS NOT NULL GROUP BY t.r, t.c, s.k) GROUP BY r, c) best ON best.r = t.r AND best.c = t.c)"""


@query("gap_fill", "N11", sql(
    """SELECT p3.r AS "row", p3.c AS "col", p3.k AS class, CASE WHEN g.k IS NULL AND p3.k IS NOT NULL THEN 'gap_filled' ELSE 'survey' END AS source
       FROM p3 JOIN p0 g USING (r, c)""",
    """gc AS (SELECT r, c, w, CASE WHEN elev <= 980 AND class IS NOT NULL THEN class END AS k FROM cells),
       gap AS (SELECT r, c, CAST(r AS BIGINT) * w + c AS id FROM gc WHERE k IS NULL),
       reach AS (SELECT id, id AS other FROM gap UNION
         SELECT reach.id, b.id FROM reach JOIN gap a ON a.id = reach.other
         JOIN gap b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
       comp AS (SELECT gap.r, gap.c, count(*) AS size FROM reach JOIN gap USING (id) GROUP BY gap.r, gap.c),
       p0 AS (SELECT gc.r, gc.c, gc.k, coalesce(comp.size <= 3, false) AS small FROM gc LEFT JOIN comp USING (r, c))""",
    _pass(1), _pass(2), _pass(3)))
def gap_fill(i: Inputs) -> DataFrame:
    cells = _gappy(i).select(*CELL, "class").withColumn("source", F.lit("survey"))
    return components.fill_gaps(cells, i.grid, source="source", max_gap_ha=3 * i.grid.cell_ha)


@query("directional_transects", "N12", sql(
    f"""SELECT asset, CAST(bearing AS DOUBLE) AS bearing, CASE WHEN n1 > 0 THEN h1 / n1 >= 0.5 END AS seg1, {rd('round_even(h1 / nullif(n1, 0), 4)')} AS frac1,
          CASE WHEN n2 > 0 THEN h2 / n2 >= 0.5 END AS seg2, {rd('round_even(h2 / nullif(n2, 0), 4)')} AS frac2,
          coalesce(h1 / nullif(n1, 0) >= 0.5, false) AND coalesce(h2 / nullif(n2, 0) >= 0.5, false) AS viable, {rd('100.0 * miss / n')} AS pct_missing
        FROM agg""",
    """ray AS (SELECT b * 15.0 AS bearing, k + 1 AS seg, k * 200 + 12.5 + j * 25.0 AS d FROM range(1, 25) x(b), range(0, 2) y(k), range(0, 8) z(j)),
       hit AS (SELECT s.id AS asset, bearing, seg, cells.grade AS e FROM stations s CROSS JOIN ray CROSS JOIN dims LEFT JOIN cells
         ON cells.r = CAST(floor((dims.w * 25 - (s.y + d * cos(radians(bearing)))) / 25) AS INTEGER)
         AND cells.c = CAST(floor((s.x + d * sin(radians(bearing))) / 25) AS INTEGER)),
       agg AS (SELECT asset, bearing, CAST(count(e) FILTER (seg = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (seg = 1 AND e >= 0.6) AS DOUBLE) AS h1,
         CAST(count(e) FILTER (seg = 2) AS DOUBLE) AS n2, CAST(count(*) FILTER (seg = 2 AND e >= 0.6) AS DOUBLE) AS h2,
         count(*) FILTER (e IS NULL) AS miss, count(*) AS n FROM hit GROUP BY asset, bearing)"""))
def directional_transects(i: Inputs) -> DataFrame:
    assets = i.stations().withColumnRenamed("id", "asset")
    return directional.directional(assets, i.cells(), i.grid, value="grade", segments=[200.0, 200.0], interval=15.0, thresh_viable=0.5)


@query("bearing_ranges", "N13", sql(
    """SELECT asset, min(bearing) AS first, max(bearing) AS last FROM (
         SELECT asset, bearing, bearing - row_number() OVER (PARTITION BY asset ORDER BY bearing) AS isl FROM seen) GROUP BY asset, isl""",
    """seen AS (SELECT DISTINCT l_suppkey AS asset, CAST(1 + l_partkey % 360 AS INTEGER) AS bearing FROM lineitem)"""))
def bearing_ranges(i: Inputs) -> DataFrame:
    seen = i.table("lineitem").select(
        F.col("l_suppkey").alias("asset"), (1 + F.col("l_partkey") % 360).cast("int").alias("bearing")).distinct()
    return directional.bearing_ranges(seen.withColumn("viable", F.lit(True)))


def _auc_sql(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {g}CASE WHEN sum(p) > 0 AND sum(1 - p) > 0 THEN (sum(CASE WHEN p = 1 THEN rk END) - sum(p)::DOUBLE * (sum(p) + 1) / 2)
  / (sum(p)::DOUBLE * sum(1 - p)) END AS auc, sum(p)::BIGINT AS n_pos, sum(1 - p)::BIGINT AS n_neg FROM (
  SELECT *, rank() OVER ({part}ORDER BY v) + (count(*) OVER (PARTITION BY {g}v) - 1) / 2.0 AS rk FROM {src}) {'GROUP BY ' + by if by else ''})"""


@query("radius_calibration", "N14", sql(
    f"""SELECT CAST(radius AS DOUBLE) AS radius, {rd('auc')} AS auc, n_pos, auc = max(auc) OVER () AS best FROM {_auc_sql('sc', 'radius')}""",
    _ring(75, name="ra"), _ring(100, name="rb"), _ring(150, name="rc"),
    _focal("grade", "ra", name="fa"), _focal("grade", "rb", name="fb"), _focal("grade", "rc", name="fc"),
    """sw AS (SELECT 75 AS radius, r, c, s / 28.0 AS v FROM fa WHERE n = 28 UNION ALL SELECT 100, r, c, s / 48.0 FROM fb WHERE n = 48
       UNION ALL SELECT 150, r, c, s / 112.0 FROM fc WHERE n = 112),
       sc AS (SELECT radius, round(v, 9) AS v, CASE WHEN burnt.r IS NULL THEN 0 ELSE 1 END AS p FROM sw LEFT JOIN burnt USING (r, c))"""))
def radius_calibration(i: Inputs) -> DataFrame:
    got = validate.calibrate_radius(i.cells(), i.grid, "grade", i.burnt(), [75, 100, 150])
    return got.select("radius", "auc", "n_pos", "best")


@query("rasterize_squares", "J05", sql('SELECT fire_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col" FROM fire_cells'))
def rasterize_squares(i: Inputs) -> DataFrame:
    return raster.rasterize(i.fires(), i.grid, "fire_id").select("fire_id", *CELL)


@query("rasterize_touching", "J05", sql(
    """SELECT fire_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col" FROM (
       SELECT fire_id, c0, side, unnest(range(r0 - 1, r0 + side + 1)) AS r FROM fires), LATERAL (SELECT unnest(range(c0 - 1, c0 + side + 1)) AS c), dims
       WHERE r BETWEEN 0 AND w - 1 AND c BETWEEN 0 AND w - 1"""))
def rasterize_touching(i: Inputs) -> DataFrame:
    from emberline.operators.raster import rectangle

    f = i.fires().withColumns({"xmin": F.col("xmin") - 5, "xmax": F.col("xmax") + 5, "ymin": F.col("ymin") - 5, "ymax": F.col("ymax") + 5})
    f = f.withColumn("rings", rectangle("xmin", "ymin", "xmax", "ymax"))
    return raster.rasterize(f, i.grid, "fire_id", touches=True).select("fire_id", *CELL)


@query("landcover_polygon_cells", "J05 S08", sql(
    """SELECT r AS "row", c AS "col", CAST(100 + max(fire_id) % 7 AS VARCHAR) AS class FROM diamond_cells GROUP BY r, c"""))
def landcover_polygon_cells(i: Inputs) -> DataFrame:
    from emberline.sources.landcover import class_cells

    return class_cells(i.diamonds(), i.grid, "fire_id")


def _shifted(i: Inputs, res: float) -> GridSpec:
    n = int(i.side * RES // res)
    return GridSpec(0.0, i.grid.ymax, res, n, n)


@query("align_near_finer", "J06", sql(
    """SELECT CAST(fr AS INTEGER) AS "row", CAST(fc AS INTEGER) AS "col", class FROM
         (SELECT unnest(range(0, CAST(floor(w * 2.5) AS BIGINT))) AS fr, CAST(floor(w * 2.5) AS BIGINT) AS m FROM dims),
         LATERAL (SELECT unnest(range(0, m)) AS fc)
       LEFT JOIN cells ON cells.r = floor((fr + 0.5) * 10 / 25) AND cells.c = floor((fc + 0.5) * 10 / 25)"""))
def align_near(i: Inputs) -> DataFrame:
    return raster.align(i.cells(), i.grid, _shifted(i, 10.0), ["class"], "near")


@query("align_average_coarser", "J06", sql(
    f"""SELECT CAST(tr AS INTEGER) AS "row", CAST(tc AS INTEGER) AS "col", {rd('sum(v * a) / sum(CASE WHEN v IS NOT NULL THEN a END)')} AS holed
        FROM ov GROUP BY tr, tc""",
    """ov AS (SELECT holed AS v, pop, tr, tc, (least(c * 25 + 25, tc * 60 + 60) - greatest(c * 25, tc * 60)) *
         (least(r * 25 + 25, tr * 60 + 60) - greatest(r * 25, tr * 60)) / 625.0 AS a
       FROM (SELECT *, unnest(range(r * 25 // 60, (r * 25 + 24) // 60 + 1)) AS tr FROM cells), LATERAL (SELECT unnest(range(c * 25 // 60, (c * 25 + 24) // 60 + 1)) AS tc)
       WHERE tr < w * 25 // 60 AND tc < w * 25 // 60)"""))
def align_average(i: Inputs) -> DataFrame:
    return raster.align(i.cells(), i.grid, _shifted(i, 60.0), ["holed"], "average")


@query("align_bilinear", "J06 S12", sql(
    f"""SELECT CAST(fr AS INTEGER) AS "row", CAST(fc AS INTEGER) AS "col", CASE WHEN count(*) = count(elev) THEN {rd('sum(wt * elev)')} END AS elev
        FROM four LEFT JOIN cells ON cells.r = sr AND cells.c = sc GROUP BY fr, fc""",
    """tgt AS (SELECT fr, fc, least(greatest((fr + 0.5) * 10 / 25 - 0.5, 0), w - 1) AS fy, least(greatest((fc + 0.5) * 10 / 25 - 0.5, 0), w - 1) AS fx
         FROM (SELECT w, unnest(range(0, CAST(floor(w * 2.5) AS BIGINT))) AS fr, CAST(floor(w * 2.5) AS BIGINT) AS m FROM dims), LATERAL (SELECT unnest(range(0, m)) AS fc)),
       four AS (SELECT fr, fc, floor(fy) + dy AS sr, floor(fx) + dx AS sc,
         (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS wt
         FROM tgt, range(0, 2) a(dy), range(0, 2) b(dx) WHERE wt > 0)"""))
def align_bilinear(i: Inputs) -> DataFrame:
    from emberline.sources.rasters import elevation

    tiles = i.cells().select(*CELL, "elev", F.lit(1).alias("tile"))
    return elevation(tiles, i.grid, _shifted(i, 10.0))


@query("population_regridded", "S13 J06", sql(
    f"""SELECT CAST(tr AS INTEGER) AS "row", CAST(tc AS INTEGER) AS "col", {rd('sum(pop * a)')} AS pop FROM ov GROUP BY tr, tc""",
    """ov AS (SELECT pop, tr, tc, (least(c * 25 + 25, tc * 60 + 60) - greatest(c * 25, tc * 60)) *
         (least(r * 25 + 25, tr * 60 + 60) - greatest(r * 25, tr * 60)) / 625.0 AS a
       FROM (SELECT *, unnest(range(r * 25 // 60, (r * 25 + 24) // 60 + 1)) AS tr FROM cells), LATERAL (SELECT unnest(range(c * 25 // 60, (c * 25 + 24) // 60 + 1)) AS tc)
       WHERE tr < w * 25 // 60 + 1 AND tc < w * 25 // 60 + 1)"""))
def population_regridded(i: Inputs) -> DataFrame:
    from emberline.sources.rasters import population

    n = int(i.side * RES // 60) + 1
    return population(i.cells(), i.grid, GridSpec(0.0, i.grid.ymax, 60.0, n, n))


@query("population_drift", "S13", sql(
    f"""SELECT {rd('b')} AS before, {rd('a')} AS after, {rd('100 * (a - b) / greatest(b, 1)')} AS drift_pct FROM (SELECT sum(pop) AS b FROM cells), (SELECT sum(v) AS a FROM share)""",
    """share AS (SELECT tr, tc, sum(pop * (least(c * 25 + 25, tc * 60 + 60) - greatest(c * 25, tc * 60)) * (least(r * 25 + 25, tr * 60 + 60) - greatest(r * 25, tr * 60)) / 625.0) AS v
       FROM (SELECT *, unnest(range(r * 25 // 60, (r * 25 + 24) // 60 + 1)) AS tr FROM cells), LATERAL (SELECT unnest(range(c * 25 // 60, (c * 25 + 24) // 60 + 1)) AS tc)
       GROUP BY tr, tc)"""))
def population_drift(i: Inputs) -> DataFrame:
    from emberline.sources.rasters import population, population_drift

    n = int(i.side * RES // 60) + 1
    after = population(i.cells(), i.grid, GridSpec(0.0, i.grid.ymax, 60.0, n, n))
    return population_drift(i.cells(), after)


@query("mosaic_first_tile", "J08", sql(
    f"""SELECT scene, r AS "row", c AS "col", {rd('arg_min(nir, tile)')} AS nir FROM bands GROUP BY scene, r, c"""))
def mosaic_first(i: Inputs) -> DataFrame:
    return raster.mosaic(i.bands(), "nir", "tile", ["scene"])


@query("auc_by_language", "A12", sql(
    f"SELECT lang, {rd('auc')} AS auc, n_pos, n_neg FROM {_auc_sql('sc', 'lang')}",
    "sc AS (SELECT lang, score AS v, CAST(hit AS INTEGER) AS p FROM scored)"))
def auc_by_language(i: Inputs) -> DataFrame:
    return auc(i.scored(), "score", "hit", ["lang"])


@query("auc_against_burnt", "A12 A13", sql(
    f"SELECT {rd('auc')} AS auc, n_pos, n_neg FROM {_auc_sql('sc')}",
    "sc AS (SELECT holed AS v, CASE WHEN burnt.r IS NULL THEN 0 ELSE 1 END AS p FROM cells LEFT JOIN burnt USING (r, c) WHERE holed IS NOT NULL)"))
def auc_burnt(i: Inputs) -> DataFrame:
    return auc(validate.score_against(i.cells(), "holed", i.burnt()), "score", "burnt")


_SC = "sc AS (SELECT holed AS v, CASE WHEN burnt.r IS NULL THEN 0 ELSE 1 END AS p FROM cells LEFT JOIN burnt USING (r, c) WHERE holed IS NOT NULL)"


@query("risk_class_table", "A10", sql(
    f"""SELECT CAST(bin AS INTEGER) AS bin, CAST(lo AS DOUBLE) AS lower, CAST(hi AS DOUBLE) AS upper, cells AS cells_total, burnt AS cells_burnt,
          {rd('round_even(100.0 * cells / sum(cells) OVER (), 2)')} AS pct_of_area, {rd('round_even(100.0 * burnt / sum(burnt) OVER (), 2)')} AS pct_of_burnt,
          CASE WHEN cells > 0 THEN {rd('round_even((burnt / sum(burnt) OVER ()) / (cells / sum(cells) OVER ()), 2)')} END AS ratio
        FROM (SELECT bin, lo, hi, count(v) AS cells, count(v) FILTER (p = 1) AS burnt FROM bounds LEFT JOIN binned USING (bin) GROUP BY bin, lo, hi)""",
    _SC, """bounds(bin, lo, hi) AS (VALUES (1, 0.0, 0.2), (2, 0.2, 0.4), (3, 0.4, 0.6), (4, 0.6, 0.8), (5, 0.8, 1.0)),
    binned AS (SELECT v, p, CASE WHEN v < 0.2 THEN 1 WHEN v <= 0.4 THEN 2 WHEN v <= 0.6 THEN 3 WHEN v <= 0.8 THEN 4 ELSE 5 END AS bin FROM sc)"""))
def risk_class_table(i: Inputs) -> DataFrame:
    return validate.class_table(validate.score_against(i.cells(), "holed", i.burnt()))


@query("roc_curve", "A11", sql(
    f"""SELECT t AS threshold, {rd('count(*) FILTER (p = 1 AND v >= t) / sum(p)')} AS tpr, {rd('count(*) FILTER (p = 0 AND v >= t) / sum(1 - p)')} AS fpr
        FROM th CROSS JOIN sc GROUP BY t""",
    _SC, """th AS (SELECT DISTINCT unnest(quantile_cont(v, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) AS t FROM sc
      UNION SELECT 'inf'::DOUBLE UNION SELECT '-inf'::DOUBLE)"""))
def roc_curve(i: Inputs) -> DataFrame:
    return validate.roc(validate.score_against(i.cells(), "holed", i.burnt()), 9)


@query("temporal_bias", "A08", sql(
    f"""SELECT CAST(b AS INTEGER) AS bin, CASE b WHEN 1 THEN '<= 0' WHEN 2 THEN '1 to 20' ELSE '> 20' END AS lag_years, count(bin) AS n_fires,
          {rd('round_even(coalesce(sum(area_ha), 0), 1)')} AS area_ha, {rd('round_even(100 * round_even(coalesce(sum(area_ha), 0), 1) / (SELECT sum(area_ha) FROM fires), 1)')} AS pct_area
        FROM (VALUES (1), (2), (3)) AS v(b) LEFT JOIN
          (SELECT *, CASE WHEN fire_year <= 1996 THEN 1 WHEN fire_year <= 2016 THEN 2 ELSE 3 END AS bin FROM fires) ON b = bin GROUP BY b"""))
def temporal_bias(i: Inputs) -> DataFrame:
    return validate.temporal_bins(i.fires(), 1996, 20)
