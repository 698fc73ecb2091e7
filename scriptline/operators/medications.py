"""The medications table and the catalogues of prescribed medicines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.functions import bnf

# Medicines last prescribed up to this day are not shown; chapters of this prefix are devices.
INDEX_DATE = "2017-04-01"
DEVICE_PREFIX = "2"


def _sorted_list(links: DataFrame, value: str, name: str) -> DataFrame:
    return links.where(F.col(value).isNotNull()).groupBy("vpid").agg(F.sort_array(F.collect_list(value)).alias(name))


def medications(
    vmp: DataFrame, amp: DataFrame, code_map: DataFrame, ont: DataFrame, form_routes: DataFrame, vpi: DataFrame
) -> DataFrame:
    """Virtual products and actual products with their code, form/routes and ingredients.

    A product mapped to several codes has a row for each; one without codes has one with NULL. Lists are per
    virtual product (a handful of entries) and empty where nothing is recorded.
    """
    descr = ont.join(form_routes.select(F.col("cd").alias("formcd"), "descr"), "formcd")
    lists = (
        vmp.select(F.col("vpid").alias("vmp_id"), F.col("vtmid").alias("vtm_id"), "nm", "invalid")
        .join(_sorted_list(descr, "descr", "form_routes").withColumnRenamed("vpid", "vmp_id"), "vmp_id", "left")
        .join(_sorted_list(vpi, "isid", "ingredient_ids").withColumnRenamed("vpid", "vmp_id"), "vmp_id", "left")
        .withColumn("form_routes", F.coalesce("form_routes", F.array().cast("array<string>")))
        .withColumn("ingredient_ids", F.coalesce("ingredient_ids", F.array().cast("array<bigint>")))
    )
    virtual = lists.select(
        F.col("vmp_id").alias("id"), F.col("nm").alias("name"), F.lit(False).alias("is_amp"), "vmp_id", "vtm_id", "invalid", "form_routes", "ingredient_ids"
    )
    actual = amp.select("apid", F.col("vpid").alias("vmp_id"), "descr", F.col("invalid").alias("amp_invalid")).join(lists, "vmp_id").select(
        F.col("apid").alias("id"), F.col("descr").alias("name"), F.lit(True).alias("is_amp"), "vmp_id", "vtm_id", F.col("amp_invalid").alias("invalid"), "form_routes", "ingredient_ids"
    )
    codes = code_map.select(F.col("dmd_id").alias("id"), "bnf_code")
    return (
        virtual.unionByName(actual)
        .join(codes, "id", "left")
        .select("id", "bnf_code", "name", "is_amp", "vmp_id", "vtm_id", "invalid", "form_routes", "ingredient_ids")
    )


def presentations_recent(presentation: DataFrame, after: str = INDEX_DATE) -> DataFrame:
    """Distinct codes last prescribed after (not on) a day."""
    return presentation.where(F.col("last_prescribed_date") > F.lit(after).cast("date")).select("bnf_code").distinct()


def medications_prescribed(meds: DataFrame, recent: DataFrame) -> DataFrame:
    """Medications with a recent code, and virtual products with a recent actual product."""
    own = meds.join(recent.withColumn("_own", F.lit(True)), "bnf_code", "left")
    parents = (
        meds.where("is_amp").join(recent, "bnf_code", "left_semi").select(F.col("vmp_id").alias("id")).distinct().withColumn("_child", F.lit(True))
    )
    return (
        own.join(parents, "id", "left")
        .where(F.col("_own").isNotNull() | (~F.col("is_amp") & F.col("_child").isNotNull()))
        .select(*meds.columns)
    )


def catalog_vtm(prescribed: DataFrame, vtm: DataFrame) -> DataFrame:
    used = prescribed.select(F.col("vtm_id").alias("vtmid")).distinct()
    return vtm.join(used, "vtmid", "left_semi").select(F.col("vtmid").alias("id"), F.col("nm").alias("name"))


def catalog_vmp(prescribed: DataFrame) -> DataFrame:
    return prescribed.where(~F.col("is_amp")).select("id", "vtm_id", "name")


def catalog_amp(prescribed: DataFrame) -> DataFrame:
    return prescribed.where("is_amp").select("id", "vmp_id", "name")


def catalog_ingredient(prescribed: DataFrame, ing: DataFrame, vpi: DataFrame) -> DataFrame:
    """Distinct ingredients of prescribed virtual products."""
    used = vpi.join(prescribed.select(F.col("vmp_id").alias("vpid")).distinct(), "vpid", "left_semi").select("isid").distinct()
    return ing.join(used, "isid", "left_semi").select(F.col("isid").alias("id"), F.col("nm").alias("name")).distinct()


def catalog_form_route(prescribed: DataFrame, form_routes: DataFrame, ont: DataFrame) -> DataFrame:
    """Distinct form/routes of prescribed virtual products."""
    used = ont.join(prescribed.select(F.col("vmp_id").alias("vpid")).distinct(), "vpid", "left_semi").select(F.col("formcd").alias("cd")).distinct()
    return form_routes.join(used, "cd", "left_semi").select(F.col("cd").alias("id"), "descr").distinct()


def catalog_bnf(prescribed: DataFrame, codes: DataFrame) -> DataFrame:
    """Prescribed presentations (no devices), their ancestors, and strength equivalents as level 6."""
    used = prescribed.select(F.col("bnf_code").alias("code")).distinct()
    shown = codes.where((F.col("level") == bnf.PRESENTATION) & ~F.col("code").startswith(DEVICE_PREFIX)).join(used, "code", "left_semi")
    above = shown.select(F.explode(bnf.prefixes(F.col("code"))).alias("code")).distinct()
    ancestors = codes.join(above, "code", "left_semi")
    equivalents = shown.select(bnf.generic_equivalent_code(F.col("code")).alias("code")).distinct()
    strengths = codes.join(equivalents, "code", "left_semi").select(
        bnf.strength_code(F.col("code")).alias("code"), F.lit(bnf.PRODUCT).alias("level"), bnf.strength_name(F.col("name")).alias("name")
    )
    columns = ["code", F.col("level").cast("int").alias("level"), "name"]
    return ancestors.select(*columns).unionByName(strengths.select(*columns)).unionByName(shown.select(*columns))
