"""Dense surrogate keys without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptline.session import written

_POSITION_BITS = 33


def running_totals(df: DataFrame, order_by: list[Column], weight: str, name: str) -> DataFrame:
    """Adds the sum of ``weight`` over all rows before each row of a total order, on all executors (see ``dense_ids``)."""
    placed = written(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id()),
        "running_totals",
    ).withColumn("_piece", F.shiftright("_at", _POSITION_BITS))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_piece").agg(F.sum(weight).alias("_n"))
    offsets = offsets.select("_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight).over(within), F.lit(0))
    return placed.withColumn("_before", before).join(F.broadcast(offsets), "_piece").select(*df.columns, (F.col("_before") + F.col("_offset")).alias(name))


def dense_ids(df: DataFrame, order_by: list[Column], name: str = "id", start: int = 0) -> DataFrame:
    """Number rows 0, 1, 2 ... in the given total order, on all executors.

    Rows are range-partitioned and sorted; each keeps its position in its partition. The positions are written
    out once, so both readers below see the same partitioning. Only one offset per partition is then summed in
    order, and that table has as many rows as there are partitions.
    """
    placed = written(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id()),
        "dense_ids",
    )
    piece = F.shiftright("_at", _POSITION_BITS)
    place = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(piece.alias("_piece"))
        .count()
        .select("_piece", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_piece", piece)
        .join(F.broadcast(offsets), "_piece")
        .select((place + F.col("_offset") + F.lit(start)).alias(name), *df.columns)
    )
