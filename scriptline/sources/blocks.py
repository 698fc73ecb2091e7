"""Text files cut into blocks that are read in parallel, although a record's borders depend on all that is before it.

A file is read as pieces between one separator, in as many blocks as Spark makes splits. What a piece starts in (inside
quotes, how deep in brackets, which record) is the composition of all pieces before it: it is taken within each run of
at most ``RUN`` pieces of a block, then over the runs' results, of which there is one row each, and the runs are told
where they start. So what a task holds at once is bounded, whatever the size of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ("file", "block")

# Pieces that are looked at together: 2 to this power. Runs of a block follow each other in order of ``_run``.
_RUN_BITS = 14
RUN = 1 << _RUN_BITS
_RUNS = (*BLOCK, "_run")


def _in_runs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_run", F.shiftright("at", _RUN_BITS))


def pieces(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, at, text): the pieces of all files of a path; ``at`` grows within a block."""
    text = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        text.alias("text"),
    )


def count_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of the file before each one."""
    counted = _in_runs(rows).withColumn("_value", value.cast("long"))
    within = Window.partitionBy(*_RUNS).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file").orderBy("block", "_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counted.groupBy(*_RUNS).agg(F.sum("_value").alias("_sum"))
    runs = runs.select(*_RUNS, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    placed = counted.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(runs, list(_RUNS))
    return placed.withColumn(name, F.col("_inner") + F.col("_ahead")).drop("_value", "_inner", "_ahead", "_run")


def _composed(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], whole: str) -> DataFrame:
    """Adds ``before`` (the rows before) or ``after`` (these and the row) as states 0 or 1 for a start in 0 and in 1.

    A row is a function of the state (from_0, from_1): it keeps it, swaps it, or sets it. What counts is the last row
    that sets it, and how many swap it since.
    """
    until = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    span = until if whole == "after" else Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_0") > F.col("from_1")).cast("int")
    swapped = rows.withColumn("_swaps", F.sum(swap).over(until))
    sets = F.when(F.col("from_0") == F.col("from_1"), F.struct(F.col("from_0").alias("state"), F.col("_swaps").alias("swaps")))
    known = swapped.withColumn("_set", F.last(sets, ignorenulls=True).over(span))
    swaps = F.col("_swaps") - (0 if whole == "after" else swap)

    def started(state: int) -> Column:
        return F.pmod(F.when(F.col("_set").isNull(), state + swaps).otherwise(F.col("_set.state") + swaps - F.col("_set.swaps")), F.lit(2)).cast("int")

    return known.withColumn(f"{whole}_0", started(0)).withColumn(f"{whole}_1", started(1)).drop("_swaps", "_set")


def state_before(rows: DataFrame, name: str) -> DataFrame:
    """Adds the state, 0 or 1, in which each row starts; its columns from_0 and from_1 say in which it ends."""
    rows = _in_runs(rows)
    within = _composed(rows, _RUNS, ("at",), "before")
    ends = _composed(rows, _RUNS, ("at",), "after").groupBy(*_RUNS)
    runs = ends.agg(F.max_by("after_0", "at").alias("from_0"), F.max_by("after_1", "at").alias("from_1"))
    started = _composed(runs, ("file",), ("block", "_run"), "before").select(*_RUNS, F.col("before_0").alias("_start"))
    state = F.when(F.col("_start") == 0, F.col("before_0")).otherwise(F.col("before_1"))
    return within.join(started, list(_RUNS)).withColumn(name, state).drop("before_0", "before_1", "_start", "from_0", "from_1", "_run")
