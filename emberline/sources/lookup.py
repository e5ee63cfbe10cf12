"""Lookup tables: built-in nomenclatures and user CSV files, validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.errors import BadLookup
from emberline.functions.constants import FUEL_TYPES, NOMENCLATURES, NOT_BURNABLE, values_table
from emberline.functions.scalars import truthy

OPTIONAL = ["nomenclature", "label", "crown_cover", "confidence", "notes"]


def builtin_lookup(spark: SparkSession, nomenclature: str) -> DataFrame:
    """Code, fuel type and burnable flag of a shipped nomenclature."""
    if nomenclature not in NOMENCLATURES:
        raise BadLookup(f"no nomenclature '{nomenclature}'; there are {sorted(NOMENCLATURES)}")
    rows = [(code, t, t not in NOT_BURNABLE) for code, t in NOMENCLATURES[nomenclature].items()]
    return values_table(spark, ["code", "fuel_type", "burnable"], rows)


def validate_lookup(raw: DataFrame) -> DataFrame:
    """A lookup with typed columns, or an error that names what is wrong.

    Codes must be unique, flags readable and fuel types in the closed list.
    """
    missing = [c for c in ("code", "fuel_type", "burnable") if c not in raw.columns]
    if missing:
        raise BadLookup(f"lookup lacks {missing}")
    extra = [F.col(c).cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    table = raw.select(F.trim(F.col("code").cast("string")).alias("code"), F.trim("fuel_type").alias("fuel_type"),
                       F.col("burnable").cast("string").alias("_raw"), truthy("burnable").alias("burnable"), *extra)
    r = table.agg(
        (F.count("code") - F.count_distinct("code")).alias("dup"), F.count_if(F.col("burnable").isNull()).alias("flag"),
        F.count_if(~F.coalesce(F.col("fuel_type").isin(*FUEL_TYPES), F.lit(False))).alias("type")).first()
    if r["dup"]:
        raise BadLookup(f"{r['dup']} duplicate codes")
    if r["flag"]:
        raise BadLookup(f"{r['flag']} unreadable burnable flags")
    if r["type"]:
        raise BadLookup(f"{r['type']} unknown fuel types")
    return table.drop("_raw")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return validate_lookup(spark.read.option("header", True).csv(path))
