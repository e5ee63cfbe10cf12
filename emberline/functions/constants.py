"""Fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed list of fuel types and the availability weight of each.
FUEL_WEIGHTS = {
    "sclerophyll_closed": 0.95,
    "broadleaf_closed": 0.60,
    "conifer_closed": 0.95,
    "mixed_closed": 0.80,
    "broadleaf_open": 0.65,
    "conifer_open": 0.90,
    "mixed_open": 0.80,
    "poplar_plantation": 0.30,
    "unstocked": 0.60,
    "shrubland": 1.00,
    "transitional_shrub": 0.90,
    "grassland": 0.70,
    "agroforestry": 0.50,
    "mosaic_agri_natural": 0.35,
    "sparse_vegetation": 0.30,
    "burnt_regrowth": 0.70,
    "urban_vegetation": 0.25,
    "cropland": 0.00,
    "non_fuel": 0.00,
}
FUEL_TYPES = tuple(FUEL_WEIGHTS)

# Fuel type of each nomenclature code. A type is burnable unless it is
# cropland or non_fuel.
NOT_BURNABLE = ("cropland", "non_fuel")
NOMENCLATURES = {
    "bdforet_v2": {
        "FF0": "unstocked", "FF1-00": "broadleaf_closed", "FF1G01-01": "broadleaf_closed",
        "FF1G06-06": "sclerophyll_closed", "FF1-09-09": "broadleaf_closed", "FF1-10-10": "broadleaf_closed",
        "FF1-14-14": "broadleaf_closed", "FF1-49-49": "broadleaf_closed", "FF1-00-00": "broadleaf_closed",
        "FF2-00": "conifer_closed", "FF2-51-51": "conifer_closed", "FF2-52-52": "conifer_closed",
        "FF2G53-53": "conifer_closed", "FF2-57-57": "conifer_closed", "FF2G58-58": "conifer_closed",
        "FF2-81-81": "conifer_closed", "FF2-80-80": "conifer_closed", "FF2G61-61": "conifer_closed",
        "FF2-63-63": "conifer_closed", "FF2-64-64": "conifer_closed", "FF2-91-91": "conifer_closed",
        "FF2-90-90": "conifer_closed", "FF2-00-00": "conifer_closed", "FF31": "mixed_closed",
        "FF32": "mixed_closed", "FO0": "unstocked", "FO1": "broadleaf_open", "FO2": "conifer_open",
        "FO3": "mixed_open", "FP": "poplar_plantation", "LA4": "shrubland", "LA6": "grassland",
    },
    "clc": {
        "111": "non_fuel", "112": "non_fuel", "121": "non_fuel", "122": "non_fuel", "123": "non_fuel",
        "124": "non_fuel", "131": "non_fuel", "132": "non_fuel", "133": "non_fuel", "141": "urban_vegetation",
        "142": "urban_vegetation", "211": "cropland", "212": "cropland", "213": "cropland", "221": "cropland",
        "222": "cropland", "223": "cropland", "231": "cropland", "241": "cropland", "242": "cropland",
        "243": "mosaic_agri_natural", "244": "agroforestry", "311": "broadleaf_closed", "312": "conifer_closed",
        "313": "mixed_closed", "321": "grassland", "322": "shrubland", "323": "shrubland",
        "324": "transitional_shrub", "331": "non_fuel", "332": "non_fuel", "333": "sparse_vegetation",
        "334": "burnt_regrowth", "335": "non_fuel", "411": "non_fuel", "412": "non_fuel", "421": "non_fuel",
        "422": "non_fuel", "423": "non_fuel", "511": "non_fuel", "512": "non_fuel", "521": "non_fuel",
        "522": "non_fuel", "523": "non_fuel",
    },
    "worldcover": {
        "10": "broadleaf_closed", "20": "shrubland", "30": "grassland", "40": "cropland", "50": "non_fuel",
        "60": "sparse_vegetation", "70": "non_fuel", "80": "non_fuel", "90": "grassland", "95": "non_fuel",
        "100": "sparse_vegetation",
    },
}

# Danger classes, lower bound included.
DANGER_SCHEMES = {
    "effis": ((11.2, 21.3, 38.0, 50.0, 70.0),
              ("Low", "Moderate", "High", "Very High", "Extreme", "Very Extreme")),
    "caliver_europe": ((2.0, 5.0, 10.0, 19.0, 33.0),
                       ("Very Low", "Low", "Moderate", "High", "Very High", "Extreme")),
}

# Exposure radii in metres (least, greatest) by process.
EXPOSURE_RADII = {"radiant": (0.1, 30.0), "ember_short": (0.1, 100.0), "ember": (100.1, 500.0)}

# Directional transects.
SEGMENTS_M = (5000.0, 5000.0, 5000.0)
BEARING_STEP = 1.0
EXPOSURE_FLOOR = 0.6
VIABLE_SHARE = 0.8

# Minimum mapping unit in hectares of the sources that claim complete
# coverage; None where the source is natively a raster and has no such unit.
MAPPING_UNIT_HA = {
    "clc": 25.0, "clc_1990": 25.0, "clc_2000": 25.0, "clc_2006": 25.0, "clc_2012": 25.0, "clc_2018": 25.0,
    "worldcover_2020": None, "worldcover_2021": None,
}

# Which source decides a cell that two of them map; higher wins.
SOURCE_RANK = {
    "bdforet_v2": 40, "worldcover_2021": 30, "worldcover_2020": 30,
    "clc": 10, "clc_2018": 10, "clc_2012": 10, "clc_2006": 10, "clc_2000": 10, "clc_1990": 10,
}
VINTAGE_FIRST = ("bdforet_v2", "bdforet_v1")

# Campaign window of the forest survey.
SURVEY_WINDOW = (2007, 2018)

# Point-cloud metric bands in file order, with units; bulk-density
# profile bands follow, and -1 stands for "not computed".
LIDAR_UNITS = {
    "Profil_Type": "profile type code", "Profil_Type_L": "profile type code (A-D)", "threshold": "kg/m3",
    "Height": "m", "CBH": "m", "FSG": "m", "Top_Fuel": "m", "H_Bush": "m", "continuity": "0/1",
    "VCI_PAD": "dimensionless", "VCI_lidr": "dimensionless", "entropy_lidr": "dimensionless",
    "PAI_tot": "m2/m2", "CBD_max": "kg/m3", "CFL": "kg/m2", "TFL": "kg/m2", "MFL": "kg/m2", "FL_1_3": "kg/m2",
    "GSFL": "kg/m2", "FL_0_1": "kg/m2", "FMA": None, "date": "gpstime", "Cover": "fraction",
    "Cover_4": "fraction", "Cover_6": "fraction",
}
LIDAR_FUEL_METRICS = ("Height", "CBH", "FSG", "H_Bush", "CBD_max", "CFL", "TFL", "MFL", "FL_0_1", "FL_1_3", "GSFL",
                      "Cover", "PAI_tot")
LIDAR_PROFILE_BANDS = 150
LIDAR_NULL = -1
LIDAR_MIN_DENSITY = 10.0
PROFILE_METRICS = ("H_Bush", "FL_0_1", "FL_1_3", "Cover", "PAI_tot")

# Standard starting codes of the Fire Weather Index system.
FWI_START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}
DANGER_SEASON = ("04-01", "10-31")


def values_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table the optimizer can see into, for lookups known in advance."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def exposure_radii(spark: SparkSession) -> DataFrame:
    rows = [(k, lo, hi) for k, (lo, hi) in EXPOSURE_RADII.items()]
    return values_table(spark, ["type", "min_m", "max_m"], rows)


def directional_defaults(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, s, BEARING_STEP, EXPOSURE_FLOOR, VIABLE_SHARE) for i, s in enumerate(SEGMENTS_M)]
    return values_table(spark, ["segment", "length_m", "interval", "thresh_exp", "thresh_viable"], rows)


def fuel_types(spark: SparkSession) -> DataFrame:
    rows = [(t, t not in NOT_BURNABLE) for t in FUEL_TYPES]
    return values_table(spark, ["fuel_type", "burnable"], rows)
