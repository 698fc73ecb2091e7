"""Choosing among downloaded files and reading a mixed set of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.functions import filenames
from scriptline.session import plain_path


def latest_file_per_month(names: DataFrame) -> DataFrame:
    """(date, name): the lexically greatest name per date. Hidden files are skipped, other forms of name fail."""
    return (
        names.where(~filenames.is_hidden(F.col("name")))
        .groupBy(filenames.name_date(F.col("name")).alias("date"))
        .agg(F.max("name").alias("name"))
    )


def file_names(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name) of the files matching a pattern; their content is not read."""
    path = F.col("path")
    return spark.read.format("binaryFile").load(pattern).select("path", F.element_at(F.split(path, "/"), -1).alias("name"))


def _ending(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in _READERS:
        raise ValueError(f"Unknown kind of file: {path}")
    return ending


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read one file or folder by the ending of its name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _READERS[_ending(path)](spark, [path]))


def union_files_with_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as one table, columns matched by name, with ``_filename``, the path as it was given.

    There is one scan for all Parquet files, one for all JSON files and one for each header of CSV files, however many
    files there are; a file's name comes with its rows. Parquet files whose types don't fit are scanned by schema, and a
    column that is text in one scan is text.
    """
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kinds.setdefault(_ending(path), []).append(path)
    scans = [table for kind, own in kinds.items() for table in _READERS[kind](spark, own)]
    kinds_of: dict[str, set[str]] = {}
    for column, kind in (c for t in scans for c in t.dtypes):
        kinds_of.setdefault(column, set()).add(kind)
    mixed = {c for c, found in kinds_of.items() if len(found) > 1 and "string" in found}
    given = F.create_map(*(F.lit(x) for path in paths for x in (plain_path(spark, path), path)))
    place = F.url_decode(F.regexp_replace(filenames.path_place(F.col("_metadata.file_path")), r"\+", "%2B"))
    name = F.try_element_at(given, F.regexp_replace(place, r"^[A-Za-z0-9+.-]+:(//[^/]*)?", ""))
    named = [_as_text(t.select("*", F.coalesce(name, place).alias("_filename")), mixed) for t in scans]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _as_text(table: DataFrame, columns: set[str]) -> DataFrame:
    """Columns that are text in one scan are text in all."""
    return table.withColumns({c: F.col(f"`{c}`").cast("string") for c in table.columns if c in columns})


def _parquet(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    try:
        return [spark.read.option("mergeSchema", True).parquet(*paths)]
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" not in str(error):
            raise
    by_schema: dict[str, list[str]] = {}
    for path in paths:
        by_schema.setdefault(spark.read.parquet(path).schema.simpleString(), []).append(path)
    return [spark.read.parquet(*own) for own in by_schema.values()]


def _json(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    return [spark.read.json(paths)]


def _csv(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One scan for each header: the first lines are read in one job."""
    found = spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0)
    first = found.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    heads = first.groupBy("file").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
    return [spark.read.csv([unquote(f) for f in r["files"]], header=True) for r in heads.orderBy("head").collect()]


_READERS: dict[str, Callable[[SparkSession, list[str]], list[DataFrame]]] = {"parquet": _parquet, "json": _json, "jsonl": _json, "csv": _csv}
