"""Resolution of code replacement chains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptline.session import written

# Copies of each definition; look-ups of one popular code spread over as many tasks.
LOOKUP_SALTS = 16


def follow_pointers(steps: DataFrame, key: str, target: str, what: str) -> DataFrame:
    """Follow ``target`` from every key to a value that is no key itself; (key, target) afterwards.

    Each round doubles the distance covered and drops finished rows from the join, so a chain of n steps takes
    log2(n) rounds. Rows that still move after that are on a cycle.
    """
    moving = written(steps.select(key, target), "chain")
    rounds = math.ceil(math.log2(moving.count() + 1)) + 1
    finished = None
    for _ in range(rounds):
        ahead = moving.select(F.col(key).alias("_at"), F.col(target).alias("_next"))
        if finished is not None:
            ahead = ahead.unionByName(finished.select(F.col(key).alias("_at"), F.col(target).alias("_next")))
        stepped = written(
            moving.join(ahead, F.col(target) == F.col("_at"), "left").select(
                key, F.coalesce("_next", target).alias(target), F.col("_next").isNotNull().alias("_moved")
            ),
            "chain",
        )
        done = stepped.where(~F.col("_moved")).select(key, target)
        finished = done if finished is None else finished.unionByName(done)
        moving = stepped.where("_moved").select(key, target)
        if moving.isEmpty():
            return finished
    stuck = moving.agg(F.min(target)).first()[0]
    raise ValueError(f"Cycle detected in {what} chain involving {stuck}")


def vmp_code_change_chain(pairs: DataFrame) -> DataFrame:
    """(vpid, vpidprev) pairs -> (old_vpid, new_vpid) with every old id pointing at the id in use today.

    Where two products name the same previous id, the greater current id wins. A cycle is an error.
    """
    steps = (
        pairs.where(F.col("vpidprev").isNotNull())
        .groupBy(F.col("vpidprev").alias("old_vpid"))
        .agg(F.max("vpid").alias("new_vpid"))
    )
    return follow_pointers(steps, "old_vpid", "new_vpid", "vpidprev")


def bnf_code_change_chain(changes: DataFrame) -> DataFrame:
    """Fold yearly change rows (year, line, old, new) into one (old_code, new_code) mapping.

    Years apply newest first, lines in file order. A new code that was itself replaced earlier in that order
    resolves to its replacement at that moment; the last row of an old code is the one that stays.

    So each row points at the latest earlier row whose old code is its new code, and the rows form chains that
    can be followed in parallel.
    """
    order = F.struct((-F.col("year")).alias("newest_first"), F.col("line").alias("line"))
    rows = changes.select(order.alias("at"), "old", "new")
    # A look-up reads the state before its own row, so at equal positions it sorts before the definition.
    salts = F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1)))
    defined = rows.select(F.col("old").alias("code"), "at", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("old"), "new", salts.alias("salt"))
    lookups = rows.select(
        F.col("new").alias("code"), "at", F.lit(0).alias("turn"), "old", "new",
        F.pmod(F.xxhash64("old", "at"), F.lit(LOOKUP_SALTS)).cast("int").alias("salt"),
    )
    so_far = Window.partitionBy("code", "salt").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, -1)
    pointed = (
        defined.unionByName(lookups)
        .withColumn("source", F.last(F.when(F.col("turn") == 1, F.col("at")), ignorenulls=True).over(so_far))
        .where(F.col("turn") == 0)
        .select("at", "old", "new", "source")
    )
    pointed = written(pointed, "code_changes")
    linked = pointed.where(F.col("source").isNotNull()).select("at", "source")
    ends = follow_pointers(linked, "at", "source", "code change") if not linked.isEmpty() else linked
    target = pointed.select(F.col("at").alias("source"), F.col("new").alias("resolved"))
    resolved = (
        pointed.drop("source")
        .join(ends, "at", "left")
        .join(target, "source", "left")
        .select("at", F.col("old").alias("old_code"), F.coalesce("resolved", "new").alias("new_code"))
    )
    return resolved.groupBy("old_code").agg(F.max_by("new_code", "at").alias("new_code"))
