"""Clustered fact tables, ingest manifests and catalogue snapshots."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptline.operators.ids import running_totals
from scriptline.session import path_exists

CLUSTER_KEYS = ("presentation_id", "date_id", "practice_id")

# About the bytes of a fact in a shuffle, what a range should have of them, and how many ranges a shuffle can have.
# Beyond that ranges are larger; their sort spills.
ROW_BYTES, RANGE_BYTES, MOST_RANGES = 64, 256 << 20, 50_000


def write_clustered(norm: DataFrame, path: str, keys: tuple[str, ...] = CLUSTER_KEYS) -> None:
    """Write the fact ordered by presentation, month and practice, so scans skip row groups by their min/max.

    The range partitioning uses all keys: a presentation with a large share of the rows spans many partitions.
    Sampling the ranges evaluates ``norm`` once more; ``write_in_ranges`` doesn't.
    """
    norm.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def range_number(rows: int, cores: int, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges for so many facts: by size, but no fewer than keep the cores busy with at least a megabyte each."""
    size = rows * ROW_BYTES
    return max(1, min(MOST_RANGES, max(math.ceil(size / range_bytes), min(cores, math.ceil(size / (1 << 20))))))


def cell_ranges(cells: DataFrame, number: int) -> DataFrame:
    """(presentation_id, steps) of cells (presentation_id, date_id, n): about equal ranges in order.

    A presentation's rows of month d belong to the last of its ``steps`` (date_id, range, parts) that begins at d or
    before. A month that is larger than a range is dealt to ``parts`` of them. All steps together are no more than
    presentations and ranges, with two for each month that is dealt.
    """
    totals = running_totals(cells.groupBy("presentation_id").agg(F.sum("n").alias("total")), [F.col("presentation_id")], "total", "start")
    size = F.greatest(F.lit(1), F.ceil(cells.agg(F.sum("n")).scalar() / F.lit(number)))
    by_month = Window.partitionBy("presentation_id").orderBy("date_id")
    start = F.col("start") + F.coalesce(F.sum("n").over(by_month.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.join(totals.select("presentation_id", "start"), "presentation_id").withColumn("start", start)
    step = F.struct(F.floor(F.col("start") / size).cast("int").alias("range"), F.ceil(F.col("n") / size).cast("int").alias("parts"))
    steps = placed.select("presentation_id", "date_id", step.alias("step")).withColumn("last", F.lag("step").over(by_month))
    kept = steps.where(F.col("last").isNull() | (F.col("last") != F.col("step")))
    return kept.groupBy("presentation_id").agg(F.sort_array(F.collect_list(F.struct("date_id", "step.range", "step.parts"))).alias("steps"))


def write_in_ranges(norm: DataFrame, path: str, number: int, keys: tuple[str, ...] = CLUSTER_KEYS) -> None:
    """``write_clustered`` in one evaluation and one shuffle of ``norm``, which has the steps of each row's presentation.

    A presentation with a large share of the rows is cut by month, and a month of it by practice.
    """
    month = F.col("date_id")
    # Nearly all presentations lie in one range.
    step = F.when(F.size("steps") == 1, F.get("steps", F.lit(0))).otherwise(F.element_at(F.filter("steps", lambda s: s["date_id"] <= month), -1))
    part = F.pmod(F.xxhash64("practice_id"), step["parts"]).cast("int")
    dealt = norm.withColumn("range", F.least(step["range"] + part, F.lit(number - 1))).drop("steps")
    dealt.repartitionById(number, F.col("range")).sortWithinPartitions(*keys).drop("range").write.parquet(path)


def ingest_manifest(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name, status): how the files at hand differ from those already ingested. No rows = nothing to do.

    status is "new" or "gone".
    """
    new = current.select("name").distinct().join(recorded.select("name"), "name", "left_anti").withColumn("status", F.lit("new"))
    gone = recorded.select("name").distinct().join(current.select("name"), "name", "left_anti").withColumn("status", F.lit("gone"))
    return new.unionByName(gone)


def file_manifest(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, status): how the files at hand (name, path, size, modified) differ from those already ingested.

    status is "new", "gone" or "changed" (another size or time).
    """
    facts = [F.struct("size", "modified").alias(side) for side in ("now", "then")]
    now, then = current.select("path", facts[0]), recorded.select("path", facts[1])
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "path", "full").select("path", status.alias("status")).where(F.col("status").isNotNull())


def needs_ingest(current: DataFrame, recorded: DataFrame | None, force: bool = False) -> bool:
    """Whether to rebuild: the files changed, nothing was ingested yet, or it is forced.

    Files that are known by name alone are compared by name.
    """
    if force or recorded is None:
        return True
    whole = {"path", "size", "modified"}
    compare = file_manifest if whole <= set(current.columns) & set(recorded.columns) else ingest_manifest
    return not compare(current, recorded).isEmpty()


def snapshot_high_water_mark(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(dataset, name, mark, ingest): newest file per dataset, to ingest when greater than the recorded name."""
    newest = files.groupBy("dataset").agg(F.max("name").alias("name"))
    mark = F.coalesce("mark", F.lit(""))
    return newest.join(marks.select("dataset", "mark"), "dataset", "left").select("dataset", "name", mark.alias("mark"), (F.col("name") > mark).alias("ingest"))


def files_after_mark(files: DataFrame, mark: str) -> DataFrame:
    """Dated files later than a recorded date (every month of them is loaded, not only the newest)."""
    return files.where(F.col("date") > F.lit(mark).cast("date"))


@dataclass(frozen=True)
class SnapshotFolder:
    """Versions of a set of tables under one folder. The pointer to the version in use is written last."""

    spark: SparkSession
    root: str

    def version_path(self, version: str) -> str:
        return f"{self.root}/versions/{version}"

    def current(self) -> str | None:
        """The version readers use; None before the first one."""
        pointers = self._pointers()
        if pointers is None:
            return None
        row = pointers.agg(F.max_by("version", "at")).first()
        return row[0]

    def record(self, version: str, files: DataFrame) -> None:
        """Write the list of a version's files; readers don't use it before ``switch``."""
        files.write.parquet(f"{self.version_path(version)}/ingested_file")

    def files(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.version_path(version)}/ingested_file")

    def switch(self, version: str) -> None:
        pointer = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
        pointer.write.mode("append").parquet(f"{self.root}/current")

    def publish(self, version: str, files: DataFrame) -> None:
        """Record the ingested files, then switch to the version."""
        self.record(version, files)
        self.switch(version)

    def recorded(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.files(version)

    def _pointers(self) -> DataFrame | None:
        if not path_exists(self.spark, f"{self.root}/current"):
            return None
        return self.spark.read.schema("version STRING, at TIMESTAMP").parquet(f"{self.root}/current")
