"""Stored analyses, and the codes of all of them at once."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.operators.medicine_filter import Catalogue, MedicineFilter, filter_flags, filter_hits, refuse_unknown
from scriptline.session import local_rows

# Filters that are columns of one plan; only its form depends on it.
FLAGGED = 32
NUMERATOR, DENOMINATOR = "numerator", "denominator"
OUTPUT_VALUES = {"items": "items", "quantity": "quantity", "cost": "actual_cost"}
# The keys of a measure's definition.
KEYS = {"metadata", "options", "queries"}
METADATA_KEYS = {"title", "tags", "why_it_matters"}
OPTION_KEYS = {"type", "output_value"}


@dataclass(frozen=True)
class Measure:
    """A stored analysis. Without a denominator the measure is per thousand registered patients."""

    name: str
    numerator: MedicineFilter
    denominator: MedicineFilter | None = None
    title: str = ""
    tags: tuple[str, ...] = ()
    output_value: str = "items"

    def __post_init__(self):
        if self.output_value not in OUTPUT_VALUES:
            raise ValueError(f"output_value: {self.output_value!r}")

    @property
    def value(self) -> str:
        """The fact's column that is summed."""
        return OUTPUT_VALUES[self.output_value]

    @classmethod
    def from_dict(cls, name: str, values: dict) -> Measure:
        """A measure from its definition: metadata, and one numerator with or without denominator. Unknown keys fail."""
        refuse_unknown(values, KEYS, f"measure {name}")
        refuse_unknown(values.get("metadata", {}), METADATA_KEYS, f"metadata of {name}")
        refuse_unknown(values.get("options", {}), OPTION_KEYS, f"options of {name}")
        queries = values["queries"]
        if len(queries) != 1:
            raise ValueError("only one simultaneous query is currently supported")
        refuse_unknown(queries[0], {NUMERATOR, DENOMINATOR}, f"query of {name}")
        for side in queries[0].values():
            if side.get("form_routes") and (side.get("forms") or side.get("routes")):
                raise ValueError("`form_routes` cannot be used at the same time as `forms` or `routes`")
        below = queries[0].get(DENOMINATOR)
        metadata = values.get("metadata", {})
        return cls(
            name,
            MedicineFilter.from_dict(queries[0][NUMERATOR]),
            None if below is None else MedicineFilter.from_dict(below),
            metadata.get("title", ""),
            tuple(metadata.get("tags", ())),
            values.get("options", {}).get("output_value", "items"),
        )

    def sides(self) -> list[tuple[str, MedicineFilter]]:
        below = [] if self.denominator is None else [(DENOMINATOR, self.denominator)]
        return [(NUMERATOR, self.numerator), *below]


def _labelled_sides(measures: list[Measure]) -> dict[str, tuple[str, str, MedicineFilter]]:
    names = [m.name for m in measures]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"measures of one name: {', '.join(twice)}")
    return {f"{i}:{side}": (measure.name, side, query) for i, measure in enumerate(measures) for side, query in measure.sides()}


def measure_sides(measures: list[Measure], catalogue: Catalogue) -> DataFrame:
    """(code, sides): per catalogued code the (measure, side) pairs that select it, if any. Names are unique.

    Up to ``FLAGGED`` filters are flag columns of one pass over the codes; more are rows, so that the plan keeps its size.
    """
    sides = _labelled_sides(measures)
    if len(sides) > FLAGGED:
        return measure_code_bridge(measures, catalogue).groupBy(F.col("bnf_code").alias("code")).agg(F.collect_list(F.struct("measure", "side")).alias("sides"))
    flags = filter_flags({key: query for key, (_, _, query) in sides.items()}, catalogue)
    hits = [
        F.when(F.col(f"`{key}`"), F.struct(F.lit(name).alias("measure"), F.lit(side).alias("side")))
        for key, (name, side, _) in sides.items()
    ]
    return flags.select("code", F.array_compact(F.array(*hits)).alias("sides")).where(F.size("sides") > 0)


def measure_code_bridge(measures: list[Measure], catalogue: Catalogue) -> DataFrame:
    """(measure, side, bnf_code) of all filters of all measures, which are rows: the plan is the same for any number."""
    sides = _labelled_sides(measures)
    hits = filter_hits({key: query for key, (_, _, query) in sides.items()}, catalogue)
    labels = [(key, name, side) for key, (name, side, _) in sides.items()]
    labels = local_rows(catalogue.codes.sparkSession, labels, filter=pa.string(), measure=pa.string(), side=pa.string())
    return hits.join(F.broadcast(labels), "filter").select("measure", "side", F.col("code").alias("bnf_code"))
