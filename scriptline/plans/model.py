"""The tables an analysis reads, built from sources or read from a written snapshot."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.operators import star
from scriptline.operators.medicine_filter import Catalogue
from scriptline.session import checked_broadcast, written
from scriptline.sources.snapshots import SnapshotFolder, cell_ranges, needs_ingest, range_number, write_in_ranges


@dataclass(frozen=True)
class Model:
    """The inputs of an analysis.

    facts (presentation_id, practice_code, date, items ...), presentation (id, bnf_code), list_size
    (practice_code, date, total), dates (date), practices (code, latest_prescribing_date), orgs (id, org_type,
    name), members (org_id, org_type, practice_code; see operators.orgs.org_practices) and the medicine catalogue.

    The counts are upper bounds of the dimension tables, taken where counting is cheap. Dimensions with a known
    small count are broadcast; without one, Spark decides at run time.
    """

    facts: DataFrame
    presentation: DataFrame
    list_size: DataFrame
    dates: DataFrame
    practices: DataFrame
    orgs: DataFrame
    members: DataFrame
    catalogue: Catalogue
    clustered: bool = False
    presentation_rows: int | None = None
    practice_rows: int | None = None
    org_rows: int | None = None


def model_from_sources(
    source: DataFrame, list_sizes: DataFrame, orgs: DataFrame, members: DataFrame, catalogue: Catalogue
) -> Model:
    """An analysis model straight on source rows; months, practices and codes are their own keys."""
    facts = source.where(F.col("practice_code") != star.NO_PRACTICE).withColumn("presentation_id", F.col("bnf_code"))
    presentation = source.select(F.col("bnf_code").alias("id"), "bnf_code").distinct()
    dates = source.select("date").distinct()
    return Model(facts.drop("bnf_code"), presentation, list_sizes, dates, star.latest_by_practice(source), orgs, members, catalogue)


def write_star(
    source: DataFrame, list_sizes: DataFrame, bnf_changes: DataFrame, vmp_changes: DataFrame, path: str
) -> None:
    """Build the star schema and write it under ``path``; dimensions first, then the facts that use their ids.

    The source is evaluated twice: once for all keys with their rows, and once for the facts. Presentations with more
    rows than a range, which are no more than there are ranges, are counted by month in one more look at their own rows.
    """
    spark = source.sparkSession
    keys = written(star.source_keys(source), "source_keys")
    used = keys.where(F.col("kind") == star.BY_PRESENTATION).select("bnf_code", "snomed_code", F.col("latest").alias("date"), "n")
    known = keys.where((F.col("kind") == star.BY_PRACTICE) & (F.col("practice_code") != star.NO_PRACTICE))
    practice = known.select("practice_code", F.col("latest").alias("date"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    dates = stored(star.date_dim(keys.where(F.col("kind") == star.BY_MONTH).select(F.col("month").alias("date"))), "date")
    practices = stored(star.practice_dim(practice), "practice")
    presentation = stored(
        star.presentation_current_codes(star.presentation_dim(used), bnf_changes, vmp_changes), "presentation"
    )
    original = presentation.select(
        "id", F.col("original_bnf_code").alias("bnf_code"), F.col("original_snomed_code").alias("snomed_code")
    )
    numbered = used.where("n > 0").join(original.withColumnRenamed("id", "presentation_id"), ["bnf_code", "snomed_code"])
    counted = used.agg(F.sum("n")).first()[0] or 0
    number = range_number(counted, spark.sparkContext.defaultParallelism)
    is_large = F.col("n") > math.ceil(counted / number)
    cells = numbered.select("presentation_id", F.lit(0).alias("date_id"), "n")
    if not used.where(is_large).isEmpty():
        by_date = dates.select(F.col("id").alias("date_id"), "date")
        large = F.broadcast(numbered.where(is_large).select("presentation_id", "bnf_code", "snomed_code"))  # at most ``number`` rows
        rows_of = source.where(F.col("practice_code") != star.NO_PRACTICE).join(large, ["bnf_code", "snomed_code"])
        months = rows_of.groupBy("presentation_id", "date").agg(F.count(F.lit(1)).alias("n"))
        cells = cells.where(~is_large).unionByName(months.join(by_date, "date").select("presentation_id", "date_id", "n"))
    steps = cell_ranges(written(cells, "cells"), number)
    ranged = written(original.join(steps.withColumnRenamed("presentation_id", "id"), "id"), "ranged")
    rows = (dates.count(), practices.count(), ranged.agg(F.sum(F.size("steps"))).first()[0] or 0)
    norm = star.prescribing_norm(source, dates, practices, ranged, ("steps",), rows)
    write_in_ranges(norm, f"{path}/prescribing_norm", number)
    stored(star.list_size_norm(list_sizes, dates, practices), "list_size_norm")


def read_star(spark: SparkSession, path: str, orgs: DataFrame, members: DataFrame, catalogue: Catalogue) -> Model:
    """The model on a written star: facts keep presentation_id and date_id, so filters on them skip row groups."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    dates, practices, presentation = table("date"), table("practice"), table("presentation")
    practice_rows = practices.count()
    by_date = dates.select(F.col("id").alias("date_id"), "date")
    by_practice = practices.select(F.col("id").alias("practice_id"), F.col("code").alias("practice_code"))
    facts = (
        table("prescribing_norm")
        .join(checked_broadcast(by_date, dates.count()), "date_id")
        .join(checked_broadcast(by_practice, practice_rows), "practice_id")
    )
    return Model(
        facts,
        presentation,
        star.list_size_view(table("list_size_norm"), dates, practices),
        dates,
        practices,
        orgs,
        members,
        catalogue,
        clustered=True,
        presentation_rows=presentation.count(),
        practice_rows=practice_rows,
        org_rows=orgs.count(),
    )


def ingest(
    spark: SparkSession,
    root: str,
    version: str,
    files: DataFrame,
    source: DataFrame,
    list_sizes: DataFrame,
    bnf_changes: DataFrame,
    vmp_changes: DataFrame,
    force: bool = False,
) -> bool:
    """Rebuild the star into a new version when the set of files changed. Returns whether it was rebuilt."""
    folder = SnapshotFolder(spark, root)
    if not needs_ingest(files, folder.recorded(), force):
        return False
    write_star(source, list_sizes, bnf_changes, vmp_changes, folder.version_path(version))
    folder.publish(version, files)
    return True
