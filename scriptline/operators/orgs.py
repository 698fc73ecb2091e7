"""Organisations: classification, child-to-parent edges, as-of partner and practice membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Organisation types from the largest to the smallest, and the role names that define them.
ORG_TYPES = ("nat", "reg", "icb", "sic", "pcn", "pra", "oth")
NATION, REGION, ICB, SICBL, PCN, PRACTICE, OTHER = ORG_TYPES
NATION_ID, NATION_NAME, COUNTRY = "ENGLAND", "NHS England", "ENGLAND"
REGION_ROLE = "NHS ENGLAND (REGION)"
ICB_ROLE = "INTEGRATED CARE BOARD"
SICBL_ROLE = "SUB ICB LOCATION"
PCN_ROLE = "PRIMARY CARE NETWORK"
PRACTICE_ROLE = "GP PRACTICE"
COST_CENTRE_ROLE = "PRESCRIBING COST CENTRE"
PCN_ROLE_ID, PARTNER_RELATION = "RO272", "RE8"


def type_rank(org_type: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in ORG_TYPES)), org_type)


def _org_type() -> Column:
    primary, roles = F.col("primaryRoleName"), F.col("roleName")
    return (
        F.when(primary == REGION_ROLE, REGION)
        .when(F.array_contains(roles, ICB_ROLE), ICB)
        .when(F.array_contains(roles, SICBL_ROLE), SICBL)
        .when(primary == PCN_ROLE, PCN)
        .when(F.array_contains(roles, PRACTICE_ROLE), PRACTICE)
        .when(primary == COST_CENTRE_ROLE, OTHER)
    )


def _classified(ods: DataFrame) -> DataFrame:
    return ods.where(F.col("country") == COUNTRY).withColumn("org_type", _org_type()).where(F.col("org_type").isNotNull())


def org_classify(ods: DataFrame) -> DataFrame:
    """(id, org_type, name, inactive) of every organisation of a known type, and the nation."""
    spark = ods.sparkSession
    nation = spark.range(0, 1, 1, 1).select(
        F.lit(NATION_ID).alias("id"), F.lit(NATION).alias("org_type"), F.lit(NATION_NAME).alias("name"), F.lit(False).alias("inactive")
    )
    return nation.unionByName(_classified(ods).select("id", "org_type", "name", "inactive"))


def org_partner_as_of(ods: DataFrame, as_of: str) -> DataFrame:
    """(id, pcn_id): the network each organisation partners with on a day; the latest start wins."""
    relation = F.explode(F.col("relationships")[COST_CENTRE_ROLE]).alias("rel")
    return (
        ods.where(F.col("primaryRole") == PCN_ROLE_ID)
        .select(F.col("id").alias("pcn_id"), relation)
        .where(
            (F.col("rel.relationshipTypeCode") == PARTNER_RELATION)
            & (F.col("rel.opStartDate") <= as_of)
            & ((F.col("rel.opEndDate") >= as_of) | (F.col("rel.opEndDate") == ""))
        )
        .groupBy(F.col("rel.sourceOrgCode").alias("id"))
        .agg(F.max_by("pcn_id", F.struct("rel.opStartDate", "pcn_id")).alias("pcn_id"))
    )


def org_parents(ods: DataFrame, as_of: str) -> DataFrame:
    """(child_id, parent_id) edges. A related organisation is a parent when it is of a larger type."""
    orgs = _classified(ods).select(
        "id", "org_type", F.array("RE4", "ICB", "NHSER").alias("related"), F.coalesce("isPartnerToCode", F.array().cast("array<string>")).alias("partners")
    )
    leaves = F.col("org_type").isin(PRACTICE, OTHER)
    many = leaves & (F.size("partners") > 1)
    unexpected = F.raise_error(F.concat(F.lit("Unexpected partners of "), F.col("id"))).cast("array<string>")
    none_valid = F.raise_error(F.concat(F.lit("No partner is valid for "), F.col("id"))).cast("string")
    # Only organisations with several partners take part in the as-of look-up.
    several = orgs.where(many).join(org_partner_as_of(ods, as_of), "id", "left").select(
        "id", "org_type", F.array_append("related", F.coalesce("pcn_id", none_valid)).alias("candidates")
    )
    one = orgs.where(~many).select(
        "id",
        "org_type",
        F.when(leaves | (F.size("partners") == 0), F.concat("related", "partners")).otherwise(unexpected).alias("candidates"),
    )
    children = one.unionByName(several).select(
        F.col("id").alias("child_id"), type_rank(F.col("org_type")).alias("child_rank"), F.explode("candidates").alias("parent_id")
    )
    loaded = orgs.select(F.col("id").alias("parent_id"), type_rank(F.col("org_type")).alias("parent_rank"))
    # A popular parent (an ICB, a region) is one row of the right side: no skew on the side that is built.
    edges = (
        children.join(loaded, "parent_id")
        .where(F.col("parent_rank") < F.col("child_rank"))
        .select("child_id", "parent_id")
    )
    nation = orgs.select(F.col("id").alias("child_id"), F.lit(NATION_ID).alias("parent_id"))
    return nation.unionByName(edges).distinct()


def org_verify(orgs: DataFrame) -> DataFrame:
    """(org_type, n) for every type; fails when a type has no organisation."""
    expected = F.explode(F.array(*(F.lit(t) for t in ORG_TYPES)))
    types = orgs.sparkSession.range(0, 1, 1, 1).select(expected.alias("org_type"))
    counts = orgs.groupBy("org_type").agg(F.count(F.lit(1)).alias("found"))
    missing = F.raise_error(F.concat(F.lit("No orgs of type "), F.col("org_type"))).cast("bigint")
    return types.join(counts, "org_type", "left").select("org_type", F.coalesce("found", missing).alias("n"))


def org_practices(orgs: DataFrame, edges: DataFrame) -> DataFrame:
    """(org_id, practice_code): practices by direct edge, and each practice itself.

    In long form, so the nation (which has every practice) is never one value, and joined from the side of the
    practices, whose hot partition Spark can split. Organisations without practices stay, with practice NULL.
    """
    practices = orgs.where(F.col("org_type") == PRACTICE).select(F.col("id").alias("practice_code"))
    direct = edges.select(F.col("parent_id").alias("org_id"), F.col("child_id").alias("practice_code")).join(
        practices, "practice_code", "left_semi"
    )
    own = practices.select(F.col("practice_code").alias("org_id"), "practice_code")
    members = direct.select("org_id", "practice_code").unionByName(own)
    typed = orgs.select(F.col("id").alias("org_id"), "org_type")
    placed = members.join(typed, "org_id").select("org_id", "org_type", "practice_code")
    alone = typed.join(members, "org_id", "left_anti").withColumn("practice_code", F.lit(None).cast("string"))
    return placed.unionByName(alone)


def orgs_ordered(orgs: DataFrame) -> DataFrame:
    """Organisations, largest type first, then by name."""
    return orgs.orderBy(type_rank(F.col("org_type")), "name", "id").select("id", "name", "org_type")


def search_orgs(orgs: DataFrame, text: str) -> DataFrame:
    """Organisations whose name or id contains the text (two characters at least), in any case."""
    wanted = text.strip().lower()
    if len(wanted) < 2:
        return orgs.limit(0)
    hit = reduce(lambda a, b: a | b, (F.lower(c).contains(wanted) for c in ("name", "id")))
    return orgs.where(hit)
