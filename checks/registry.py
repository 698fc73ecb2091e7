"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sample import Sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(sample) -> DataFrame`` under a name."""

    def register(build: Callable[[Sample], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Sample(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def text(df: DataFrame, *columns: str) -> DataFrame:
    """Show columns as text (dates, nullable ids)."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df
