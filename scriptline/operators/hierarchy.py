"""Operators over the code hierarchy: relations, tree, product table, names and selection state."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptline.functions import bnf
from scriptline.operators.medications import DEVICE_PREFIX


def bnf_parts(codes: DataFrame) -> DataFrame:
    return codes.select("code", bnf.parts(F.col("code")).alias("parts")).select("code", "parts.*")


def bnf_ancestors(codes: DataFrame) -> DataFrame:
    """(code, ancestor) for every catalogued code that is a proper prefix of another one."""
    lengths = tuple(range(1, 15))
    above = codes.select("code", F.explode(bnf.prefixes(F.col("code"), lengths)).alias("ancestor"))
    return above.join(codes.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").select("code", "ancestor")


def bnf_descendants(codes: DataFrame, code: str) -> DataFrame:
    """(code) below one code."""
    return codes.where(bnf.is_ancestor(F.lit(code), F.col("code"))).select("code")


def bnf_generic_equivalents(codes: DataFrame) -> DataFrame:
    """(code, generic_code): presentations with the generic ones of their chemical, strength and formulation."""
    presentations = codes.where(F.col("level") == bnf.PRESENTATION)
    parts = bnf.parts(F.col("code"))
    generics = presentations.where(bnf.is_generic(F.col("code"))).select(
        bnf.chemical(F.col("code")).alias("chemical"), parts["strength_and_formulation"].alias("strength"), F.col("code").alias("generic_code")
    )
    return (
        presentations.select(bnf.chemical(F.col("code")).alias("chemical"), parts["generic_equivalent"].alias("strength"), "code")
        .join(generics, ["chemical", "strength"])
        .select("code", "generic_code")
    )


def bnf_code_names(codes: DataFrame) -> DataFrame:
    """(code, name) of what can be selected: codes down to chemicals, and strength codes of generics."""
    upper = codes.where(F.col("level") <= bnf.CHEMICAL).select("code", "name")
    generic = codes.where((F.col("level") == bnf.PRESENTATION) & bnf.is_generic(F.col("code")))
    return upper.unionByName(
        generic.select(bnf.strength_code(F.col("code")).alias("code"), bnf.strength_name(F.col("name")).alias("name"))
    )


def code_selection_state(codes: DataFrame, included: list[str], excluded: list[str]) -> DataFrame:
    """How a selection of prefixes treats each code: directly or through an ancestor, or in part (chemicals)."""
    code = F.col("code")

    def starts(values: list[str]) -> Column:
        return reduce(or_, (code.startswith(v) for v in values), F.lit(False))

    def below(values: list[str]) -> Column:
        return reduce(or_, (bnf.is_ancestor(code, F.lit(v)) for v in values), F.lit(False))

    return codes.select(
        "code",
        code.isin(included).alias("directly_included"),
        code.isin(excluded).alias("directly_excluded"),
        starts(included).alias("included"),
        starts(excluded).alias("excluded"),
        ((F.length(code) == 9) & (below(included) | below(excluded))).alias("partially_included_chemical"),
    )


def bnf_tree(codes: DataFrame) -> DataFrame:
    """(code, name, level, parent_code, depth, path) of chapters down to chemicals, devices left out.

    The parent is the longest catalogued proper prefix. A node has at most four ancestors, so its path is short.
    """
    nodes = codes.where((F.col("level") <= bnf.CHEMICAL) & ~F.col("code").startswith(DEVICE_PREFIX))
    ancestors = (
        bnf_ancestors(nodes)
        .groupBy("code")
        .agg(F.max_by("ancestor", F.length("ancestor")).alias("parent_code"), F.sort_array(F.collect_list("ancestor")).alias("above"))
    )
    return nodes.join(ancestors, "code", "left").select(
        "code",
        "name",
        "level",
        "parent_code",
        F.coalesce(F.size("above"), F.lit(0)).alias("depth"),
        F.array_join(F.array_append(F.coalesce("above", F.array().cast("array<string>")), F.col("code")), "/").alias("path"),
    )


def bnf_product_cells(codes: DataFrame) -> DataFrame:
    """One row per presentation with its place in the product table of its chemical.

    Columns: chemical, row_code (strength code of the matching generic; NULL where the chemical has no generic),
    product_code, code, name, and how many rows and columns match (1 each in a sound catalogue).
    """
    presentations = codes.where(F.col("level") == bnf.PRESENTATION).select("code", "name", bnf.chemical(F.col("code")).alias("chemical"))
    generics = bnf_generic_equivalents(codes)
    rows = generics.groupBy("code").agg(F.min(bnf.strength_code(F.col("generic_code"))).alias("row_code"), F.count(F.lit(1)).alias("rows"))
    with_generic = presentations.where(bnf.is_generic(F.col("code"))).select("chemical", F.lit(True).alias("has_generic")).distinct()
    products = codes.where(F.col("level") == bnf.PRODUCT).select(F.col("code").alias("product_code"))
    columns = (
        presentations.select("code", F.explode(bnf.prefixes(F.col("code"), tuple(range(1, 15)))).alias("product_code"))
        .join(products, "product_code")
        .groupBy("code")
        .agg(F.min("product_code").alias("product_code"), F.count(F.lit(1)).alias("columns"))
    )
    return (
        presentations.join(with_generic, "chemical", "left")
        .join(rows, "code", "left")
        .join(columns, "code", "left")
        .select(
            "chemical",
            "row_code",
            "product_code",
            "code",
            "name",
            F.when(F.col("has_generic").isNull(), 1).otherwise(F.coalesce("rows", F.lit(0))).alias("rows"),
            F.coalesce("columns", F.lit(0)).alias("columns"),
        )
    )


def bnf_product_table(codes: DataFrame, chemical: str) -> DataFrame:
    """The product table of one chemical: a row per generic, a column per product, cells list presentations.

    Fails when a presentation does not fit exactly one row and one column. A chemical has few products, so they become
    columns; any other code is refused.
    """
    if len(chemical) != bnf.ANCESTOR_LENGTHS[-1]:
        raise ValueError(f"not the code of a chemical: {chemical!r}")
    own = codes.where(F.col("code").startswith(chemical))
    misfit = F.raise_error(F.concat(F.lit("No single cell for "), F.col("code"))).cast("string")
    cells = bnf_product_cells(own).withColumn(
        "product_code", F.when((F.col("rows") == 1) & (F.col("columns") == 1), F.col("product_code")).otherwise(misfit)
    )
    products = [r.code for r in own.where(F.col("level") == bnf.PRODUCT).select("code").orderBy("code").collect()]
    listed = F.sort_array(F.collect_list(F.struct("code", "name")))
    return cells.groupBy("row_code").pivot("product_code", products).agg(listed).orderBy("row_code")


def name_search(codes: DataFrame, text: str) -> DataFrame:
    """Codes that start with the text, or whose name contains it, in any case."""
    wanted = text.lower()
    return codes.where(F.lower("code").startswith(wanted) | F.lower("name").contains(wanted))
