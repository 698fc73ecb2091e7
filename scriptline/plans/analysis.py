"""Analyses: organisation ratios, deciles, medicine breakdowns and the measure panel, each one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptline.operators import dense, orgs
from scriptline.operators.measures import DENOMINATOR, NUMERATOR, OUTPUT_VALUES, Measure, measure_sides
from scriptline.operators.medicine_filter import MedicineFilter, filter_flags, list_size_items, matching_codes
from scriptline.plans.model import Model, checked_broadcast

# Months queried, medicines shown by name, and the scale of the two kinds of ratio.
DATE_COUNT = 96
MEDICATIONS_TOP_N = 10
PER_HUNDRED_ITEMS = 100
PER_THOUSAND_PATIENTS = 1000
OTHER = "Other"

# Literal ranges of ids pushed to the scan, and ids looked at together to find them.
ID_RANGES = 8
ID_BLOCK = 100_000


@dataclass(frozen=True)
class Analysis:
    """Items of one medicine filter against those of another, or against registered patients (None)."""

    numerator: MedicineFilter
    denominator: MedicineFilter | None = None
    org_id: str | None = None

    @classmethod
    def from_dict(cls, values: dict) -> Analysis:
        if len(values["queries"]) != 1:
            raise ValueError("We only currently support one numerator/denominator pair")
        query = values["queries"][0]
        below = query.get(DENOMINATOR)
        return cls(
            MedicineFilter.from_dict(query[NUMERATOR]),
            None if below is None else MedicineFilter.from_dict(below),
            values.get("org_id"),
        )

    def to_dict(self) -> dict:
        query = {NUMERATOR: self.numerator.to_dict()}
        kind = "prescribing_vs_list_size"
        if self.denominator is not None:
            query[DENOMINATOR] = self.denominator.to_dict()
            kind = "prescribing_vs_prescribing"
        values = {"options": {"output_value": "items", "type": kind}, "queries": [query]}
        return values | ({"org_id": self.org_id} if self.org_id else {})

    @property
    def multiplier(self) -> int:
        return PER_THOUSAND_PATIENTS if self.denominator is None else PER_HUNDRED_ITEMS


def _in_window(model: Model, rows: DataFrame, date_count: int | None) -> DataFrame:
    """Rows of the newest months. The star numbers months from the newest, so there a literal bound does."""
    if date_count is None:
        return rows
    if model.clustered:
        return rows.where(F.col("date_id") < date_count)
    return rows.where(F.col("date") >= F.array_min(dense.month_array(dense.recent_dates(model.dates, date_count))))


def _of_codes(model: Model, codes: DataFrame, date_count: int | None) -> DataFrame:
    """Facts of the given codes in the window, with ``bnf_code`` and the other columns of ``codes``.

    Codes meet the presentations first, so the facts see one small table of ids. On the star the few ranges that
    cover these ids are looked up beforehand: as literals they let the scan skip row groups of other medicines.
    """
    named = codes.withColumnRenamed("code", "bnf_code")
    ids = model.presentation.select(F.col("id").alias("presentation_id"), "bnf_code").join(named, "bnf_code")
    facts = _in_window(model, model.facts, date_count)
    if model.clustered:
        spans = [F.col("presentation_id").between(low, high) for low, high in id_ranges(ids.select("presentation_id"))]
        facts = facts.where(reduce(or_, spans, F.lit(False)) if spans else F.lit(False))
    return facts.join(checked_broadcast(ids, model.presentation_rows), "presentation_id")


def id_ranges(ids: DataFrame, most: int = ID_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover all ids: apart at the largest gaps between them."""
    before = F.lag("presentation_id").over(Window.partitionBy("_part").orderBy("presentation_id"))
    # Ids are numbered in order of codes, so blocks of them are even parts; the blocks' own ends close them.
    parts = ids.distinct().withColumn("_part", F.floor(F.col("presentation_id") / ID_BLOCK)).withColumn("_gap", F.col("presentation_id") - before)
    ends = parts.groupBy("_part").agg(
        F.min("presentation_id").alias("low"),
        F.max("presentation_id").alias("high"),
        F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("_gap") > 1, F.struct("_gap", "presentation_id"))))), 1, most).alias("gaps"),
    )
    found: list[tuple[int, int]] = []
    for row in sorted(ends.collect()):  # one short row per block of ids
        starts = sorted((g["presentation_id"], g["_gap"]) for g in row["gaps"])
        low = row["low"]
        for start, gap in starts:
            found.append((low, start - gap))
            low = start
        found.append((low, row["high"]))
    while len(found) > most:
        i = min(range(1, len(found)), key=lambda k: found[k][0] - found[k - 1][1])
        found[i - 1 : i + 1] = [(found[i - 1][0], found[i][1])]
    return found


def practice_date_matrix(model: Model, query: MedicineFilter | None, date_count: int | None = None, value: str = "items") -> DataFrame:
    """(practice_code, date, value): dense sums for practices active in the window; None = registered patients."""
    months = dense.recent_dates(model.dates, date_count)
    if query is None:
        facts = list_size_items(_in_window(model, model.list_size, date_count))
    else:
        facts = _of_codes(model, matching_codes(query, model.catalogue), date_count).withColumn("value", F.col(value))
    practices = dense.active_practices(model.practices, months).select(F.col("code").alias("practice_code"))
    return dense.filled_sum(dense.zero_cells(practices, months), facts, ["practice_code", "date"], ["value"])


def _medication_sums(model: Model, query: MedicineFilter, date_count: int | None, value: str) -> DataFrame:
    """(bnf_code, date, value) where there is anything to sum."""
    facts = _of_codes(model, matching_codes(query, model.catalogue), date_count).withColumn("value", F.col(value))
    return dense.grouped_sum(facts, ["bnf_code", "date"], ["value"]).where(F.col("value") != 0)


def medication_date_matrix(model: Model, query: MedicineFilter, date_count: int | None = None, value: str = "items") -> DataFrame:
    """(bnf_code, date, value): dense sums for the codes with prescribing in the window."""
    months = dense.recent_dates(model.dates, date_count)
    sums = _medication_sums(model, query, date_count, value)
    used = sums.select("bnf_code").distinct()
    return dense.filled_sum(dense.zero_cells(used, months), sums, ["bnf_code", "date"], ["value"])


def _sides(model: Model, analysis: Analysis, date_count: int | None, value: str) -> DataFrame:
    """(practice_code, date, num, den): both sides summed per practice and month, prescribing in one scan."""
    zero = F.lit(0).cast("bigint")
    if analysis.denominator is None:
        facts = _of_codes(model, matching_codes(analysis.numerator, model.catalogue), date_count)
        num_sums = facts.groupBy("practice_code", "date").agg(F.sum(value).alias("num")).select("practice_code", "date", "num", zero.alias("den"))
        patients = _patients(model, date_count)
        return num_sums.unionByName(patients.select("practice_code", "date", zero.alias("num"), F.col("value").alias("den")))
    codes = filter_flags({"in_num": analysis.numerator, "in_den": analysis.denominator}, model.catalogue)
    return (
        _of_codes(model, codes.where("in_num OR in_den").drop("name"), date_count)
        .groupBy("practice_code", "date")
        .agg(
            F.sum(F.when(F.col("in_num"), F.col(value)).otherwise(0)).alias("num"),
            F.sum(F.when(F.col("in_den"), F.col(value)).otherwise(0)).alias("den"),
        )
    )


def _patients(model: Model, date_count: int | None) -> DataFrame:
    """Registered patients in the window, of practices that still prescribed in it."""
    active = dense.active_practices(model.practices, dense.recent_dates(model.dates, date_count))
    kept = active.select(F.col("code").alias("practice_code"))
    return list_size_items(_in_window(model, model.list_size, date_count)).join(kept, "practice_code", "left_semi")


def _org_type(model: Model, org_id: str | None) -> Column:
    """Type of the chosen organisation (an unknown one fails), ICB when none is chosen."""
    if org_id is None:
        return F.lit(orgs.ICB)
    found = model.orgs.where(F.col("id") == org_id).select("org_type").scalar()
    return F.coalesce(found, F.raise_error(F.lit(f"Unknown organisation: {org_id}")).cast("string"))


def _members(model: Model, org_type: Column) -> DataFrame:
    """(org_id, practice_code) of the organisations of one type."""
    return model.members.where(F.col("org_type") == org_type).select("org_id", "practice_code")


def org_date_ratio(model: Model, analysis: Analysis, date_count: int | None = DATE_COUNT, value: str = "items") -> DataFrame:
    """(org_id, date, value): numerator per hundred denominator items or per thousand patients.

    One row per organisation of the chosen type and month; NULL where the denominator is zero. Facts are summed
    per practice and month before they meet the organisations, then once more per organisation.
    """
    months = dense.recent_dates(model.dates, date_count)
    org_type = _org_type(model, analysis.org_id)
    members = checked_broadcast(dense.single_group(_members(model, org_type), "practice_code", "org_id"), model.practice_rows)
    placed = _sides(model, analysis, date_count, value).join(members, "practice_code")
    rows = model.orgs.where(F.col("org_type") == org_type).select(F.col("id").alias("org_id"))
    sums = dense.filled_sum(dense.zero_cells(rows, months), placed, ["org_id", "date"], ["num", "den"])
    return sums.select("org_id", "date", (dense.ratio(F.col("num"), F.col("den")) * analysis.multiplier).alias("value"))


def all_orgs(model: Model, analysis: Analysis, date_count: int | None = DATE_COUNT) -> DataFrame:
    """(org, month, value) of every organisation."""
    return dense.records(org_date_ratio(model, analysis, date_count), "org_id", "org", "month")


def org_series(model: Model, analysis: Analysis, date_count: int | None = DATE_COUNT) -> DataFrame:
    """(month, value) of the chosen organisation; empty when none is chosen."""
    return all_orgs(model, analysis, date_count).where(F.col("org") == F.lit(analysis.org_id)).select("month", "value")


def deciles(model: Model, analysis: Analysis, date_count: int | None = DATE_COUNT) -> DataFrame:
    """(centile, month, value) over the organisations of the chosen type."""
    return dense.records(dense.centiles(org_date_ratio(model, analysis, date_count), groups=date_count, rows=model.org_rows), "centile", "centile", "month")


def top_medications_other(
    model: Model, query: MedicineFilter, date_count: int | None = DATE_COUNT, top_n: int = MEDICATIONS_TOP_N
) -> DataFrame:
    """(position, bnf_code, medication, month, value): the largest medicines, and the rest as "Other" placed last."""
    months = dense.recent_dates(model.dates, date_count)
    sums = _medication_sums(model, query, date_count, "items")
    totals = sums.groupBy("bnf_code").agg(F.sum("value").alias("total"))
    largest = totals.orderBy(F.col("total").desc(), "bnf_code").limit(top_n)
    in_order = Window.orderBy(F.col("total").desc(), "bnf_code")  # top_n rows
    names = model.catalogue.codes.select(F.col("code").alias("bnf_code"), "name")
    top = largest.withColumn("position", F.row_number().over(in_order)).join(names, "bnf_code").select("bnf_code", "position", "name")
    labelled = sums.join(F.broadcast(top), "bnf_code", "left").select(  # top_n rows
        F.coalesce("position", F.lit(top_n + 1)).alias("position"),
        F.when(F.col("position").isNotNull(), F.col("bnf_code")).alias("bnf_code"),
        F.coalesce("name", F.lit(OTHER)).alias("medication"),
        "date",
        "value",
    )
    # Zeros are added to the few bands, not to every medicine.
    bands = labelled.select("position", "bnf_code", "medication").distinct()
    filled = dense.filled_sum(dense.zero_cells(bands, months), labelled, ["position", "bnf_code", "medication", "date"], ["value"])
    return filled.withColumnRenamed("date", "month")


def stack_totals(breakdown: DataFrame, largest: str = "top", other: str = "middle") -> DataFrame:
    """Adds each medicine's total, the largest and smallest total, and the order in the stack.

    ``breakdown`` holds the few medicines of a chart, one row per medicine and month. ``largest`` is "top" or
    "bottom"; ``other`` is "top", "middle" (by its own total) or "bottom".
    """
    totals = breakdown.groupBy("medication").agg(F.sum("value").alias("medication_total"))
    extremes = totals.agg(F.struct(F.max("medication_total").alias("high"), F.min("medication_total").alias("low"))).scalar()
    total, high, low = F.col("medication_total"), F.col("max_medication_total"), F.col("min_medication_total")
    if largest == "top":
        named, above, below = total, high + 1, low - 1
    else:
        named, above, below = -total, -low + 1, -high - 1
    forced = {"top": above, "bottom": below}.get(other, named)
    return (
        breakdown.join(totals, "medication")
        .withColumn("max_medication_total", extremes["high"])
        .withColumn("min_medication_total", extremes["low"])
        .withColumn("stack_order", F.when(F.col("medication") == OTHER, forced).otherwise(named))
    )


def org_sums(model: Model, org_type: str, facts: DataFrame, columns: list[str]) -> DataFrame:
    """(bnf_code, org_id, date, *columns): sums of facts with their codes over the organisations of a type."""
    members = checked_broadcast(dense.single_group(_members(model, F.lit(org_type)), "practice_code", "org_id"), model.practice_rows)
    return dense.grouped_sum(facts.join(members, "practice_code"), ["bnf_code", "org_id", "date"], columns)


def write_org_sums(model: Model, path: str, org_type: str = orgs.ICB, months: list[str] | None = None) -> None:
    """Write ``org_sums`` of every value and code, by month: all months, or those that have changed.

    Only the facts of these months are read, and only their folders are replaced. A panel of any measures is then
    made of the sums. Codes or memberships that change ask for all months.
    """
    facts = model.facts
    if months is not None:
        wanted = model.dates.where(F.col("date").cast("string").isin(months))
        if model.clustered:
            facts = facts.where(F.col("date_id").isin([r["id"] for r in wanted.select("id").collect()]))  # a literal: it reaches the scan
        else:
            facts = facts.where(F.col("date").cast("string").isin(months))
    ids = model.presentation.select(F.col("id").alias("presentation_id"), "bnf_code")
    coded = facts.join(checked_broadcast(ids, model.presentation_rows), "presentation_id")
    sums = org_sums(model, org_type, coded, sorted(OUTPUT_VALUES.values()))
    sums.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def measure_panel(
    model: Model, measures: list[Measure], org_type: str = orgs.ICB, date_count: int | None = DATE_COUNT, sums_path: str | None = None
) -> DataFrame:
    """(measure, org_id, date, num, den, value): every measure for every organisation and month in one job.

    Values (items, or what a measure's ``output_value`` says) are summed per code, organisation and month once. Only
    these sums meet the measures of their code, so overlapping measures multiply sums and not prescribing rows.
    Measures without a denominator use the patients of the organisation. With ``sums_path`` the sums are those that
    ``write_org_sums`` keeps there, and no fact is read.
    """
    columns = sorted({m.value for m in measures}) or ["items"]
    months = dense.recent_dates(model.dates, date_count)
    sides = measure_sides(measures, model.catalogue)
    members = checked_broadcast(dense.single_group(_members(model, F.lit(org_type)), "practice_code", "org_id"), model.practice_rows)
    if sums_path is None:
        by_org = org_sums(model, org_type, _of_codes(model, sides.select("code"), date_count), columns)
    else:
        kept = model.catalogue.codes.sparkSession.read.parquet(sums_path).select("bnf_code", "org_id", "date", *columns)
        by_org = kept.where(F.array_contains(dense.month_array(months), F.col("date")))
    # Each measure reads the sum of its own column; nearly all read items.
    n = F.col(columns[0])
    for c in columns[1:]:
        n = F.when(F.col("measure").isin([m.name for m in measures if m.value == c]), F.col(c)).otherwise(n)
    is_num = F.col("side") == NUMERATOR
    prescribed = (
        by_org.join(sides.withColumnRenamed("code", "bnf_code"), "bnf_code")
        .select("org_id", "date", *columns, F.inline("sides"))
        .withColumn("n", n)
        .groupBy("measure", "org_id", "date")
        .agg(F.sum(F.when(is_num, F.col("n")).otherwise(0)).alias("num"), F.sum(F.when(~is_num, F.col("n")).otherwise(0)).alias("den"))
    )
    per_patient = [m.name for m in measures if m.denominator is None]
    patients = (
        _patients(model, date_count)
        .join(members, "practice_code")
        .groupBy("org_id", "date")
        .agg(F.sum("value").alias("den"))
    )
    zero = F.lit(0).cast("bigint")
    names = F.array(*(F.lit(n) for n in per_patient)).cast("array<string>")
    denominators = patients.select(F.explode(names).alias("measure"), "org_id", "date", zero.alias("num"), "den")
    every = F.array(*(F.lit(m.name) for m in measures))
    rows = model.orgs.where(F.col("org_type") == org_type).select(F.explode(every).alias("measure"), F.col("id").alias("org_id"))
    sums = dense.filled_sum(
        dense.zero_cells(rows, months), prescribed.unionByName(denominators), ["measure", "org_id", "date"], ["num", "den"]
    )
    times = F.when(F.col("measure").isin(per_patient), PER_THOUSAND_PATIENTS).otherwise(PER_HUNDRED_ITEMS)
    return sums.withColumn("value", dense.ratio(F.col("num"), F.col("den")) * times)


def measure_deciles(
    model: Model, measures: list[Measure], org_type: str = orgs.ICB, date_count: int | None = DATE_COUNT
) -> DataFrame:
    """(measure, centile, date, value) of every measure over the organisations of a type."""
    panel = measure_panel(model, measures, org_type, date_count)
    groups = date_count and date_count * len(measures)
    return dense.centiles(panel, ("measure", "date"), groups, model.org_rows).select("measure", "centile", "date", "value")


def measure_flags(measures: list[Measure]) -> dict[str, list[str]]:
    """Measures to look at: without a denominator, or with the placeholder prefix that matches every code."""
    return {
        "per_patient": [m.name for m in measures if m.denominator is None],
        "placeholder": [m.name for m in measures if any("" in q.bnf_codes for _, q in m.sides())],
    }


def ntr_dtr_intersection(model: Model, numerator: MedicineFilter, denominator: MedicineFilter | None) -> DataFrame:
    """(code, name, ntr, dtr): codes of either side with their membership; dtr is NULL without a denominator."""
    if denominator is None:
        found = filter_flags({"ntr": numerator}, model.catalogue).where("ntr")
        return found.select("code", "name", "ntr", F.lit(None).cast("boolean").alias("dtr")).orderBy("code")
    return filter_flags({"ntr": numerator, "dtr": denominator}, model.catalogue).where("ntr OR dtr").orderBy("code")
