"""Dimensions, normalised fact and denormalised views of the prescribing star schema.

Source rows: prescribing (bnf_code, snomed_code, date, practice_code, quantity_value, items, quantity, net_cost,
actual_cost) and list sizes (date, practice_code, total).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptline.operators.ids import dense_ids
from scriptline.session import checked_broadcast

# Practice code of unattributed prescribing, and a code above every valid medicine code.
NO_PRACTICE = "-"
LAST_CODE = "ZZZZZZZZZZZZZZZ"

MEASURED = ("quantity_value", "items", "quantity", "net_cost", "actual_cost")


def date_dim(source: DataFrame) -> DataFrame:
    """(id, date): months with prescribing, newest first from 0. Only the distinct months reach the window."""
    newest_first = Window.orderBy(F.col("date").desc())
    return source.select("date").distinct().select((F.row_number().over(newest_first) - 1).alias("id"), "date")


def latest_by_practice(source: DataFrame) -> DataFrame:
    """(code, latest_prescribing_date), without the rows no practice is known for."""
    return (
        source.where(F.col("practice_code") != NO_PRACTICE)
        .groupBy(F.col("practice_code").alias("code"))
        .agg(F.max("date").alias("latest_prescribing_date"))
    )


def practice_dim(source: DataFrame) -> DataFrame:
    """(id, code, latest_prescribing_date), most recently active first from 0."""
    return dense_ids(latest_by_practice(source), [F.col("latest_prescribing_date").desc(), F.col("code")])


def source_keys(source: DataFrame) -> DataFrame:
    """Keys of all dimensions in one pass over the source, with their latest month and number of rows.

    Rows (bnf_code, snomed_code, latest, n) per presentation, n counting those of a known practice, (practice_code, latest)
    per practice and (month) per month; ``kind`` tells them apart.
    """
    known = F.col("practice_code") != NO_PRACTICE
    keys = source.select("bnf_code", "snomed_code", "practice_code", F.col("date").alias("month"), "date", known.cast("int").alias("known"))
    sets = keys.groupingSets([["bnf_code", "snomed_code"], ["practice_code"], ["month"]], "bnf_code", "snomed_code", "practice_code", "month")
    return sets.agg(F.max("date").alias("latest"), F.sum("known").alias("n"), F.grouping_id().alias("kind"))


BY_PRESENTATION, BY_PRACTICE, BY_MONTH = 0b0011, 0b1101, 0b1110


def presentations(source: DataFrame) -> DataFrame:
    return source.groupBy("bnf_code", "snomed_code").agg(F.max("date").alias("last_prescribed_date"))


def presentation_dim(source: DataFrame) -> DataFrame:
    """(id, bnf_code, snomed_code, last_prescribed_date) in code order from 1."""
    return dense_ids(presentations(source), [F.col("bnf_code"), F.col("snomed_code")], start=1)


def presentation_current_codes(presentation: DataFrame, bnf_changes: DataFrame, vmp_changes: DataFrame) -> DataFrame:
    """Replace codes by the ones in use today and keep the original ones."""
    bnf = one_row_per_key(bnf_changes, "old_code", "new_code")
    vmp = one_row_per_key(vmp_changes, "old_vpid", "new_vpid")
    return (
        presentation.join(bnf, F.col("bnf_code") == F.col("old_code"), "left")
        .join(vmp, F.col("snomed_code") == F.col("old_vpid"), "left")
        .select(
            *([c for c in ("id",) if c in presentation.columns]),
            F.coalesce("new_code", "bnf_code").alias("bnf_code"),
            F.col("bnf_code").alias("original_bnf_code"),
            F.coalesce("new_vpid", "snomed_code").alias("snomed_code"),
            F.col("snomed_code").alias("original_snomed_code"),
            "last_prescribed_date",
        )
    )


def one_row_per_key(mapping: DataFrame, key: str, value: str) -> DataFrame:
    """The mapping, failing where a key occurs twice (it would double the rows it is joined to)."""
    twice = F.raise_error(F.concat(F.lit("Code mapped twice: "), F.col(key).cast("string")))
    found = mapping.schema[value].dataType.simpleString()
    return (
        mapping.groupBy(key)
        .agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n"))
        .select(key, F.when(F.col("_n") == 1, F.col(value)).otherwise(twice.cast(found)).alias(value))
    )


def prescribing_norm(
    source: DataFrame, dates: DataFrame, practices: DataFrame, presentation: DataFrame, extra: tuple[str, ...] = (), rows: tuple[int, int, int] | None = None
) -> DataFrame:
    """The fact with surrogate keys; rows of unknown practice drop out by the inner join.

    ``extra`` are columns of the presentation to keep. ``rows`` counts the dimensions where that is known: small ones
    are broadcast, and the fact is not shuffled to meet them.
    """
    by_date = dates.select(F.col("id").alias("date_id"), "date")
    by_practice = practices.select(F.col("id").alias("practice_id"), F.col("code").alias("practice_code"))
    by_code = presentation.select(F.col("id").alias("presentation_id"), "bnf_code", "snomed_code", *extra)
    known = rows or (None, None, None)
    return (
        source.join(checked_broadcast(by_date, known[0]), "date")
        .join(checked_broadcast(by_practice, known[1]), "practice_code")
        .join(checked_broadcast(by_code, known[2]), ["bnf_code", "snomed_code"])
        .select("presentation_id", "date_id", "practice_id", *MEASURED, *extra)
    )


def list_size_norm(source: DataFrame, dates: DataFrame, practices: DataFrame) -> DataFrame:
    """(date_id, practice_id, total) for the months and practices known from prescribing."""
    by_date = dates.select(F.col("id").alias("date_id"), "date")
    by_practice = practices.select(F.col("id").alias("practice_id"), F.col("code").alias("practice_code"))
    return (
        source.join(by_date, "date").join(by_practice, "practice_code").select("date_id", "practice_id", "total")
    )


def prescribing_view(norm: DataFrame, current: DataFrame, dates: DataFrame, practices: DataFrame) -> DataFrame:
    """The fact joined back to labels, with current codes."""
    by_code = current.select(F.col("id").alias("presentation_id"), "bnf_code", "snomed_code")
    by_date = dates.select(F.col("id").alias("date_id"), "date")
    by_practice = practices.select(F.col("id").alias("practice_id"), F.col("code").alias("practice_code"))
    return (
        norm.join(by_date, "date_id")
        .join(by_practice, "practice_id")
        .join(by_code, "presentation_id")
        .select("presentation_id", "bnf_code", "snomed_code", "date_id", "date", "practice_id", "practice_code", *MEASURED)
    )


def list_size_view(norm: DataFrame, dates: DataFrame, practices: DataFrame) -> DataFrame:
    by_date = dates.select(F.col("id").alias("date_id"), "date")
    by_practice = practices.select(F.col("id").alias("practice_id"), F.col("code").alias("practice_code"))
    return (
        norm.join(by_date, "date_id")
        .join(by_practice, "practice_id")
        .select("date_id", "date", "practice_id", "practice_code", "total")
    )


def bnf_code_ranges(presentation: DataFrame, batch_size: int = 650) -> DataFrame:
    """(batch, start, end): half-open ranges of ``batch_size`` distinct codes each, in code order."""
    numbered = dense_ids(presentation.select("bnf_code").distinct(), [F.col("bnf_code")])
    starts = numbered.where(F.col("id") % batch_size == 0).select(
        F.floor(F.col("id") / batch_size).alias("batch"), F.col("bnf_code").alias("start")
    )
    ends = starts.select((F.col("batch") - 1).alias("batch"), F.col("start").alias("end"))
    return starts.join(ends, "batch", "left").withColumn("end", F.coalesce("end", F.lit(LAST_CODE)))
