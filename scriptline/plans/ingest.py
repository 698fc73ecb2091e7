"""From folders of downloaded monthly files to a published star, in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.functions.filenames import path_name, path_place
from scriptline.plans.model import ingest
from scriptline.sources.files import latest_file_per_month
from scriptline.sources.monthly import list_size_month_alignment, scan_list_size, scan_prescribing

# Fixed value: patient-list files of the layout that is read carry this in their names.
LIST_SIZE_VERSION = "_v2_"


def monthly_files(spark: SparkSession, pattern: str, version: str = "") -> DataFrame:
    """(date, name, path, size, modified): the files of the latest name of each month, without hidden ones and other versions.

    Only the listing is read. A name may be a folder of several files that Spark wrote; one that is in two places
    fails, since its month would count twice.
    """
    listed = spark.read.format("binaryFile").load(pattern)
    files = listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = files.withColumn("name", path_name(F.col("path"))).where(F.col("name").contains(version))
    places = named.groupBy("name").agg(F.min(path_place(F.col("path"))).alias("place"), F.max(path_place(F.col("path"))).alias("other"))
    twice = F.raise_error(F.concat_ws(" ", F.lit("One file name in two folders:"), "place", "other")).cast("string")
    latest = latest_file_per_month(named).join(places, "name")
    one = latest.select("date", F.when(F.col("place") == F.col("other"), F.col("name")).otherwise(twice).alias("name"))
    return one.join(named, "name").select("date", "name", "path", "size", "modified")


def ingest_folders(
    spark: SparkSession,
    root: str,
    version: str,
    prescribing: str,
    list_sizes: str,
    bnf_changes: DataFrame,
    vmp_changes: DataFrame,
    force: bool = False,
) -> bool:
    """Build a new version of the star from the files matching two patterns, if any of them changed.

    Patient lists are taken for months with prescribing only. Returns whether a version was published.
    """
    rx = monthly_files(spark, prescribing)
    lists = list_size_month_alignment(monthly_files(spark, list_sizes, LIST_SIZE_VERSION), rx)
    found = rx.unionByName(lists).select("name", "path", "size", "modified")
    source = scan_prescribing(spark, _paths(rx))
    sizes = scan_list_size(spark, _paths(lists))
    return ingest(spark, root, version, found, source, sizes, bnf_changes, vmp_changes, force)


def _paths(files: DataFrame) -> list[str]:
    """A file or some files a month: the listing that the scan is planned with."""
    found = sorted(r["path"] for r in files.select("path").collect())
    if not found:
        raise ValueError("no monthly files")
    return found
