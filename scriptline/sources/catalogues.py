"""Loaders of the medicine and code catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels of the wide code file in order, price category names with their ids.
HIERARCHY = ("CHAPTER", "SECTION", "PARAGRAPH", "SUBPARAGRAPH", "CHEMICAL_SUBSTANCE", "PRODUCT", "PRESENTATION")
TARIFF_CATEGORIES = (("Category A", 1), ("Category C", 3), ("Category H", 15), ("Category M", 11))
TARIFF_COLUMNS = "Medicine STRING, `VMPP Snomed Code` STRING, `Drug Tariff Category` STRING, `Basic Price` STRING"


def load_bnf_codes(wide: DataFrame) -> DataFrame:
    """Wide hierarchy rows -> (code, level, name).

    A level that is missing repeats the level above, so a (code, name) keeps its shallowest level. A code with
    two names fails.
    """
    triples = ", ".join(f"{i}, BNF_{level}_CODE, BNF_{level}" for i, level in enumerate(HIERARCHY, start=1))
    long = wide.select(F.expr(f"stack({len(HIERARCHY)}, {triples}) AS (level, code, name)"))
    shallowest = long.where("code IS NOT NULL AND name IS NOT NULL").groupBy("code", "name").agg(F.min("level").alias("level"))
    two_names = F.raise_error(F.concat(F.lit("More than one name for code "), F.col("code"))).cast("boolean")
    return (
        shallowest.groupBy("code")
        .agg(F.min("level").alias("level"), F.max("name").alias("name"), F.count(F.lit(1)).alias("_n"))
        .where(F.when(F.col("_n") == 1, True).otherwise(two_names))  # a filter is never pruned, a column may be
        .select("code", "level", "name")
    )


def load_dmd_bnf_map(raw: DataFrame) -> DataFrame:
    """(dmd_id, bnf_code), without rows that are blank in part."""
    named = raw.select(F.col("SNOMED Code").alias("dmd_id"), F.col("BNF Code").alias("bnf_code"))
    filled = named.where("dmd_id IS NOT NULL AND dmd_id <> '' AND bnf_code IS NOT NULL AND bnf_code <> ''")
    return filled.select(F.col("dmd_id").cast("bigint").alias("dmd_id"), "bnf_code")


def load_ncso_concessions(raw: DataFrame) -> DataFrame:
    """(date, vmpp, price_pence) out of the ``fields`` of each JSON record."""
    return raw.select(
        F.col("fields.date").cast("date").alias("date"),
        F.col("fields.vmpp").cast("bigint").alias("vmpp"),
        F.col("fields.price_pence").cast("int").alias("price_pence"),
    )


def tariff_category_id(category: Column) -> Column:
    found = F.coalesce(*(F.when(category.contains(name), F.lit(id_)) for name, id_ in TARIFF_CATEGORIES))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("Unknown category: "), category)).cast("int"))


def load_drug_tariff(raw: DataFrame) -> DataFrame:
    """(date, vmpp_id, drug_tariff_category_id, price_in_pence) of the priced rows of dated tariff files."""
    return raw.where("`Basic Price` IS NOT NULL AND `Basic Price` <> ''").select(
        "date",
        F.col("VMPP Snomed Code").cast("bigint").alias("vmpp_id"),
        tariff_category_id(F.col("Drug Tariff Category")).alias("drug_tariff_category_id"),
        F.col("Basic Price").cast("int").alias("price_in_pence"),
    )


def replace_months(prices: DataFrame, path: str) -> None:
    """Write dated rows, replacing the months they contain and leaving the others."""
    prices.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def load_bnf_code_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="old_code STRING, new_code STRING", header=True)
