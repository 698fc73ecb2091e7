"""Faceted medicine search: which medications a set of facet selections shows, and what can still be chosen."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptline.functions import bnf
from scriptline.operators.ids import dense_ids
from scriptline.operators.medicine_filter import labelled_values
from scriptline.session import written

INGREDIENT, VTM, BNF, FORM_ROUTE = FACETS = ("ingredient", "vtm", "bnf", "form_route")
BASELINE = (INGREDIENT, VTM, BNF)
INCLUDED, EXCLUDED, NOT_INCLUDED = "included", "excluded", "not_included"
CHILD_INCLUDED = "vmp_not_included_but_child_amp_is"
NO_VTM = "No VTM"
# A product with several codes has the first of these that one of its codes has.
STATUS_ORDER = (INCLUDED, CHILD_INCLUDED, NOT_INCLUDED, EXCLUDED)


@dataclass(frozen=True)
class Selection:
    """Selected values per facet, to include and to exclude."""

    include: dict[str, list] = field(default_factory=dict)
    exclude: dict[str, list] = field(default_factory=dict)

    def active(self) -> dict[str, list]:
        return {k: v for k, v in self.include.items() if v}

    def without(self, facet: str, excluded: bool) -> Selection:
        include = {k: v for k, v in self.include.items() if excluded or k != facet}
        exclude = {k: v for k, v in self.exclude.items() if not excluded or k != facet}
        return Selection(include, exclude)

    def is_empty(self) -> bool:
        return not any(self.include.values()) and not any(self.exclude.values())


def facet_matches(facet: str, values: list) -> Column:
    """Whether a medication has any of the values of a facet (a missing field has none)."""
    if facet == INGREDIENT:
        hits = [F.array_contains("ingredient_ids", F.lit(v).cast("bigint")) for v in values]
    elif facet == VTM:
        hits = [F.col("vtm_id") == v for v in values]
    elif facet == BNF:
        hits = [F.col("bnf_code").startswith(v) for v in values]
    else:
        hits = [F.array_contains("form_routes", v) for v in values]
    return F.coalesce(reduce(or_, hits), F.lit(False))


def matches_all(selection: Selection) -> Column:
    return reduce(and_, (facet_matches(f, v) for f, v in selection.active().items()), F.lit(True))


def matches_excluded(selection: Selection) -> Column:
    return reduce(or_, (facet_matches(f, v) for f, v in selection.exclude.items() if v), F.lit(False))


def in_baseline(selection: Selection) -> Column:
    """Any active baseline facet matches; without one, all other facets must."""
    baseline = [facet_matches(f, v) for f, v in selection.active().items() if f in BASELINE]
    return reduce(or_, baseline) if baseline else matches_all(selection)


def facet_baseline(medications: DataFrame, selection: Selection) -> DataFrame:
    return medications.where(in_baseline(selection))


def facet_status(medications: DataFrame, selection: Selection) -> DataFrame:
    """Adds ``status``; an exclusion outweighs an inclusion."""
    status = F.when(matches_excluded(selection), EXCLUDED).when(matches_all(selection), INCLUDED).otherwise(NOT_INCLUDED)
    return medications.withColumn("status", status)


def facet_parent_vmps(visible: DataFrame, medications: DataFrame) -> DataFrame:
    """Virtual products that are not visible themselves but have a visible actual product."""
    wanted = visible.where("is_amp").select(F.col("vmp_id").alias("id")).distinct()
    shown = visible.where(~F.col("is_amp")).select("id").distinct()
    return medications.where(~F.col("is_amp")).join(wanted, "id", "left_semi").join(shown, "id", "left_anti").select(*medications.columns)


def facet_child_promotion(statuses: DataFrame) -> DataFrame:
    """Gives a not included virtual product with an included actual product a status of its own."""
    parents = (
        statuses.where(F.col("is_amp") & (F.col("status") == INCLUDED)).select(F.col("vmp_id").alias("id")).distinct().withColumn("_child", F.lit(True))
    )
    promoted = ~F.col("is_amp") & (F.col("status") == NOT_INCLUDED) & F.col("_child").isNotNull()
    return statuses.join(parents, "id", "left").withColumn("status", F.when(promoted, CHILD_INCLUDED).otherwise(F.col("status"))).select(*statuses.columns)


def facet_query(medications: DataFrame, selection: Selection) -> DataFrame:
    """The visible medications with their status."""
    visible = facet_baseline(medications, selection)
    shown = visible.unionByName(facet_parent_vmps(visible, medications))
    return facet_child_promotion(facet_status(shown, selection))


def facet_counts(statuses: DataFrame) -> DataFrame:
    included = F.col("status") == INCLUDED
    return statuses.agg(
        F.count_if(included).alias("included"),
        F.count_if(included & ~F.col("is_amp")).alias("included_vmps"),
        F.count_if(included & F.col("is_amp")).alias("included_amps"),
    )


def facet_lookup(ingredients: DataFrame, vtms: DataFrame, form_routes: DataFrame, codes: DataFrame) -> DataFrame:
    """(facet, value, label, sort_level) of every option. Shown in order of sort_level, label and value."""
    top = F.lit(0)
    named = F.concat("name", F.lit(" ("), bnf.level_label(F.col("level")), F.lit(")"))
    options = [
        ingredients.select(F.lit(INGREDIENT).alias("facet"), F.col("id").cast("string").alias("value"), F.col("name").alias("label"), top.alias("sort_level")),
        vtms.select(F.lit(VTM).alias("facet"), F.col("id").cast("string").alias("value"), F.col("name").alias("label"), top.alias("sort_level")),
        form_routes.select(F.lit(FORM_ROUTE).alias("facet"), F.col("descr").alias("value"), F.col("descr").alias("label"), top.alias("sort_level")),
        codes.where(F.col("level") <= bnf.PRODUCT).select(F.lit(BNF).alias("facet"), F.col("code").alias("value"), named.alias("label"), F.col("level").cast("int").alias("sort_level")),
    ]
    return reduce(DataFrame.unionByName, options)


def facet_index(medications: DataFrame, lookup: DataFrame) -> DataFrame:
    """(facet, value, id): the medications of each facet value, one row each.

    Codes are indexed by those of their prefixes that are options (strength codes are not).
    """
    bnf_options = lookup.where((F.col("facet") == BNF) & ~F.col("value").contains("_")).select("value").distinct()
    whole = F.col("bnf_code")
    starts = F.transform(F.sequence(F.lit(1), F.length(whole)), lambda n: F.substring(whole, F.lit(1), n))
    entries = [
        medications.select(F.lit(INGREDIENT).alias("facet"), F.explode(F.col("ingredient_ids").cast("array<string>")).alias("value"), "id"),
        medications.where(F.col("vtm_id").isNotNull()).select(F.lit(VTM).alias("facet"), F.col("vtm_id").cast("string").alias("value"), "id"),
        medications.select(F.lit(FORM_ROUTE).alias("facet"), F.explode("form_routes").alias("value"), "id"),
        medications.where(whole.isNotNull())
        .select(F.explode(starts).alias("value"), "id")
        .join(bnf_options, "value", "left_semi")
        .select(F.lit(BNF).alias("facet"), "value", "id"),
    ]
    return reduce(DataFrame.unionByName, entries)


@dataclass(frozen=True)
class FacetIndex:
    """Bitmaps over numbered medications: ``bits`` (facet, value, word, bits) and the ``lookup`` of the options.

    A word holds the bits of 64 medications, and only words with a bit are there: the index has no more rows than there
    are values of medications, however many values differ. Codes are indexed by every level of theirs.
    """

    bits: DataFrame
    lookup: DataFrame

    def any_of(self, facet: str, values: list) -> DataFrame:
        """(word, bits): medications with any of the values."""
        if facet == BNF and (odd := [v for v in values if len(v) not in INDEXED_LENGTHS]):
            raise ValueError(f"codes of no level: {', '.join(odd)}")
        hits = self.bits.where((F.col("facet") == facet) & F.col("value").isin([str(v) for v in values]))
        return hits.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def options(self, selection: Selection, facet: str, excluded: bool = False) -> DataFrame:
        """(value): options of one control that still leave a medication under all other selections.

        An option stays if one of its medications is in all included facets and not excluded. The selections meet by
        word first, then the options' own words meet what they leave. Nothing but bitmaps is read, and one index serves
        every selection.
        """
        options = self.lookup.where(F.col("facet") == facet).select("value").distinct()
        others = selection.without(facet, excluded)
        if others.is_empty():
            return options
        included = [self.any_of(f, v) for f, v in others.active().items()]
        out = [self.any_of(f, v) for f, v in others.exclude.items() if v]
        own = self.bits.where(F.col("facet") == facet).select("value", "word", "bits")
        if included:
            met = reduce(DataFrame.unionByName, included).groupBy("word").agg(F.bit_and("bits").alias("_in"), F.count(F.lit(1)).alias("_there"))
            own = own.join(met.where(F.col("_there") == len(included)), "word").withColumn("bits", F.col("bits").bitwiseAND(F.col("_in")))
        if out:
            removed = reduce(DataFrame.unionByName, out).groupBy("word").agg(F.bit_or("bits").alias("_out"))
            kept = F.bitwise_not(F.coalesce("_out", F.lit(0).cast("bigint")))
            own = own.join(removed, "word", "left").withColumn("bits", F.col("bits").bitwiseAND(kept))
        return options.join(own.where(F.col("bits") != 0).select("value").distinct(), "value", "left_semi")


# Lengths of the codes of all levels.
INDEXED_LENGTHS = (*bnf.ANCESTOR_LENGTHS, 11, 15)

# A word is a bigint.
_WORD_BITS = 64


def bitmap_index(medications: DataFrame, lookup: DataFrame) -> FacetIndex:
    """Build the index once; every row of the medications is a bit (a product with several codes has several).

    Rows are numbered in order of their codes, so those of a code or a prefix share words.
    """
    numbered = dense_ids(medications.select("id", "bnf_code", "vtm_id", "form_routes", "ingredient_ids"), [F.col("bnf_code"), F.col("id")], "row")
    levels = F.array_compact(F.array(*(F.when(F.length("bnf_code") >= n, F.substring("bnf_code", 1, n)) for n in INDEXED_LENGTHS)))
    entry = [
        (INGREDIENT, F.col("ingredient_ids").cast("array<string>")),
        (VTM, F.array_compact(F.array(F.col("vtm_id").cast("string")))),
        (BNF, F.when(F.col("bnf_code").isNotNull(), levels)),
        (FORM_ROUTE, F.col("form_routes")),
    ]
    values = F.flatten(F.array(*(labelled_values("facet", facet, v) for facet, v in entry)))
    entries = numbered.select("row", F.explode(F.array_distinct(values)).alias("x")).select("row", "x.*").where(F.col("value").isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("row", F.lit(_WORD_BITS)).cast("int"))
    bits = entries.groupBy("facet", "value", F.floor(F.col("row") / _WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return FacetIndex(written(bits, "facet_bits"), written(lookup.select("facet", "value"), "facet_lookup"))


def facet_options(medications: DataFrame, lookup: DataFrame, selection: Selection, facet: str, excluded: bool = False) -> DataFrame:
    """(value): ``FacetIndex.options`` of an index made for this one question."""
    return bitmap_index(medications, lookup).options(selection, facet, excluded)


def medications_grouped(statuses: DataFrame, vtms: DataFrame, vmps: DataFrame, only_matching: bool = False) -> DataFrame:
    """Medications nested as moiety > virtual product > actual product, one row per entry, in display order.

    Flat rows in place of nested lists, since one moiety ("No VTM") can hold most products. Sort by vtm_name,
    vtm_id, vmp_name, vmp_id, is_amp, name, id. ``vtm_status`` is that of the group of virtual products.
    """
    rows = statuses.where(F.col("status").isin(INCLUDED, CHILD_INCLUDED)) if only_matching else statuses
    # A virtual product without a row of its own counts as included.
    rank = F.array_position(F.array(*(F.lit(s) for s in STATUS_ORDER)), F.col("status"))
    own = rows.where(~F.col("is_amp")).groupBy("vmp_id").agg(F.min_by("status", rank).alias("_own"))
    groups = rows.select("vtm_id", "vmp_id").distinct().join(own, "vmp_id", "left").withColumn("vmp_status", F.coalesce("_own", F.lit(INCLUDED)))
    by_vtm = groups.groupBy("vtm_id").agg(
        F.when(F.bool_and(F.col("vmp_status") == EXCLUDED), EXCLUDED)
        .when(F.bool_and(F.col("vmp_status") != INCLUDED), NOT_INCLUDED)
        .otherwise(INCLUDED)
        .alias("vtm_status")
    )
    labelled = (
        rows.join(groups.select("vmp_id", "vmp_status").distinct(), "vmp_id")
        .join(by_vtm.withColumnRenamed("vtm_id", "_vtm_id"), F.col("vtm_id").eqNullSafe(F.col("_vtm_id")))
        .join(vtms.select(F.col("id").alias("vtm_id"), F.col("name").alias("vtm_name")), "vtm_id", "left")
        .join(vmps.select(F.col("id").alias("vmp_id"), F.col("name").alias("vmp_name")).distinct(), "vmp_id", "left")
    )
    return labelled.select(
        "vtm_id",
        F.when(F.col("vtm_id").isNull(), NO_VTM).otherwise(F.col("vtm_name")).alias("vtm_name"),
        "vtm_status",
        "vmp_id",
        "vmp_name",
        "vmp_status",
        "is_amp",
        "id",
        "name",
        "status",
    )
