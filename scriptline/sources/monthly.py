"""Scans over the monthly prescribing and patient-list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.functions import filenames

# Columns of the monthly files (all text; the code column has two names, SNOMED is not in all),
# and the rows of a patient-list file that are practice totals.
PRESCRIBING_COLUMNS = (
    "BNF_CODE",
    "BNF_PRESENTATION_CODE",
    "SNOMED_CODE",
    "PRACTICE_CODE",
    "QUANTITY",
    "ITEMS",
    "TOTAL_QUANTITY",
    "NIC",
    "ACTUAL_COST",
)
LIST_SIZE_COLUMNS = ("ORG_CODE", "NUMBER_OF_PATIENTS", "ORG_TYPE", "SEX", "AGE_GROUP_5")
PRACTICE_TOTAL = {"ORG_TYPE": "GP", "SEX": "ALL", "AGE_GROUP_5": "ALL"}


def _all_text(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} STRING" for c in columns)


RAW_PRESCRIBING = _all_text(PRESCRIBING_COLUMNS)


PRESCRIBING_ROW = (
    "bnf_code string, snomed_code bigint, practice_code string, quantity_value float, items int, quantity float, net_cost bigint, actual_cost bigint"
)


def _pence(pounds: str):
    return F.bround(F.col(pounds).cast("double") * 100).cast("bigint")


def scan_prescribing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Monthly files as one source table, stamped with the date in the file name.

    One scan with the union of all columns as its schema: columns a file lacks read as NULL, so files of every
    layout share a plan and no footers are merged.
    """
    return prescribing_rows(spark.read.schema(RAW_PRESCRIBING).parquet(*paths)).drop("file")


def prescribing_rows(raw: DataFrame) -> DataFrame:
    """Typed source rows of a batch or streaming read of monthly files."""
    return raw.select(
        F.coalesce("BNF_CODE", "BNF_PRESENTATION_CODE").alias("bnf_code"),
        F.coalesce(F.col("SNOMED_CODE").cast("bigint"), F.lit(0)).alias("snomed_code"),
        filenames.path_date(F.col("_metadata.file_path")).alias("date"),
        F.col("PRACTICE_CODE").alias("practice_code"),
        F.col("QUANTITY").cast("float").alias("quantity_value"),
        F.col("ITEMS").cast("int").alias("items"),
        F.col("TOTAL_QUANTITY").cast("float").alias("quantity"),
        _pence("NIC").alias("net_cost"),
        _pence("ACTUAL_COST").alias("actual_cost"),
        filenames.path_name(F.col("_metadata.file_path")).alias("file"),
    )


def practice_totals(raw: DataFrame) -> DataFrame:
    for column, value in PRACTICE_TOTAL.items():
        raw = raw.where(F.col(column) == value)
    return raw.select("date", F.col("ORG_CODE").alias("practice_code"), F.col("NUMBER_OF_PATIENTS").cast("bigint").alias("total"))


def scan_list_size(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(date, practice_code, total) from monthly patient-list files."""
    raw = spark.read.schema(_all_text(LIST_SIZE_COLUMNS)).parquet(*paths)
    return practice_totals(raw.withColumn("date", filenames.path_date(F.col("_metadata.file_path"))))


def list_size_month_alignment(list_sizes: DataFrame, prescribing_months: DataFrame) -> DataFrame:
    """List-size rows (or files) of months that also have prescribing."""
    return list_sizes.join(prescribing_months.select("date").distinct(), "date", "left_semi")
