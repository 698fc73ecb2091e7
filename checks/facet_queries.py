"""Faceted medicine search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle import sql
from checks.registry import query, text
from checks.star_queries import MED_COLUMNS, SHOWN, flat
from scriptline.operators import facets
from scriptline.operators import medications as med
from scriptline.operators.facets import Selection

PICKED = Selection(
    include={"ingredient": [5, 103], "vtm": [1003], "bnf": ["0102", "0203010"], "form_route": ["ring.small", "bolt.red"]},
    exclude={"bnf": ["0203010L0"], "form_route": ["rod.blue"]},
)
FORM_ONLY = Selection(include={"form_route": ["ring.small", "bolt.red"]})
INGREDIENT = "list_has_any(ingredient_ids, [5, 103])"
MOIETY = "coalesce(vtm_id = 1003, false)"
CODE = "coalesce(starts_with(bnf_code, '0102') OR starts_with(bnf_code, '0203010'), false)"
FORM = "list_has_any(form_routes, ['ring.small', 'bolt.red'])"
OUT = "(coalesce(starts_with(bnf_code, '0203010L0'), false) OR list_contains(form_routes, 'rod.blue'))"
ALL_IN = f"({INGREDIENT} AND {MOIETY} AND {CODE} AND {FORM})"
BASE = f"({INGREDIENT} OR {MOIETY} OR {CODE})"
STATUS = f"CASE WHEN {OUT} THEN 'excluded' WHEN {ALL_IN} THEN 'included' ELSE 'not_included' END"

# One facet more loosely, so that included actual products under products that are not included occur.
LOOSE = Selection(include={"bnf": ["01", "02"], "form_route": ["ring.small", "bolt.red"]}, exclude={"ingredient": [7]})
LOOSE_CODE = "coalesce(starts_with(bnf_code, '01') OR starts_with(bnf_code, '02'), false)"
LOOSE_STATUS = f"""CASE WHEN list_contains(ingredient_ids, 7) THEN 'excluded' WHEN {LOOSE_CODE} AND {FORM} THEN 'included'
    ELSE 'not_included' END"""
LOOSE_TABLES = {
    "visible": f"SELECT * FROM prescribed WHERE {LOOSE_CODE}",
    "extra": """SELECT * FROM prescribed WHERE NOT is_amp AND id IN (SELECT vmp_id FROM visible WHERE is_amp)
        AND id NOT IN (SELECT id FROM visible WHERE NOT is_amp)""",
    "first_status": f"SELECT *, {LOOSE_STATUS} AS st FROM (SELECT * FROM visible UNION ALL SELECT * FROM extra)",
    "shown_meds": """SELECT * EXCLUDE (st), CASE WHEN NOT is_amp AND st = 'not_included'
            AND id IN (SELECT vmp_id FROM first_status WHERE is_amp AND st = 'included')
        THEN 'vmp_not_included_but_child_amp_is' ELSE st END AS status FROM first_status""",
}


@query("facet_predicates", sql(f"SELECT id, bnf_code, {INGREDIENT} AS ingredient, {MOIETY} AS vtm, {CODE} AS bnf, {FORM} AS form_route FROM meds"))
def _(s):
    flags = [facets.facet_matches(f, PICKED.include[f]).alias(f) for f in facets.FACETS]
    return s.catalogue.medications.select("id", "bnf_code", *flags)


@query("facet_baseline", sql(f"SELECT id, bnf_code FROM prescribed WHERE {BASE}"))
def _(s):
    return facets.facet_baseline(s.prescribed, PICKED).select("id", "bnf_code")


@query("facet_baseline_other", sql(f"SELECT id, bnf_code FROM prescribed WHERE {FORM}"))
def _(s):
    return facets.facet_baseline(s.prescribed, FORM_ONLY).select("id", "bnf_code")


@query("facet_status", sql(f"SELECT id, bnf_code, {STATUS} AS status FROM prescribed"))
def _(s):
    return facets.facet_status(s.prescribed, PICKED).select("id", "bnf_code", "status")


@query("facet_parent_vmps", sql(f"SELECT {MED_COLUMNS} FROM extra", **LOOSE_TABLES))
def _(s):
    return flat(facets.facet_parent_vmps(facets.facet_baseline(s.prescribed, LOOSE), s.prescribed))


@query("facet_child_promotion", sql("SELECT id, bnf_code, is_amp, status FROM shown_meds", **LOOSE_TABLES))
def _(s):
    return facets.facet_query(s.prescribed, LOOSE).select("id", "bnf_code", "is_amp", "status")


@query(
    "facet_counts",
    sql("""SELECT count(*) FILTER (status = 'included') AS included, count(*) FILTER (status = 'included' AND NOT is_amp) AS included_vmps,
                  count(*) FILTER (status = 'included' AND is_amp) AS included_amps FROM shown_meds""", **LOOSE_TABLES),
)
def _(s):
    return facets.facet_counts(facets.facet_query(s.prescribed, LOOSE))


LOOKUP = SHOWN | {
    "used_ing": "SELECT DISTINCT i.isid AS id, i.nm AS name FROM m_ing i JOIN m_vpi v ON v.isid = i.isid WHERE v.vpid IN (SELECT vmp_id FROM prescribed)",
    "used_form": "SELECT DISTINCT f.descr FROM m_form_route f JOIN m_ont o ON o.formcd = f.cd WHERE o.vpid IN (SELECT vmp_id FROM prescribed)",
    "lookup": """SELECT 'ingredient' AS facet, CAST(id AS VARCHAR) AS value, name AS label, 0 AS sort_level FROM used_ing
        UNION ALL SELECT 'vtm', CAST(vtmid AS VARCHAR), nm, 0 FROM m_vtm WHERE vtmid IN (SELECT vtm_id FROM prescribed)
        UNION ALL SELECT 'form_route', descr, descr, 0 FROM used_form
        UNION ALL SELECT 'bnf', code, name || ' (' || ['Chapter', 'Section', 'Paragraph', 'Subparagraph', 'Chemical', 'Product'][level] || ')', level
            FROM cat_bnf WHERE level <= 6""",
    "idx": """SELECT 'ingredient' AS facet, CAST(unnest(ingredient_ids) AS VARCHAR) AS value, id FROM prescribed
        UNION ALL SELECT 'vtm', CAST(vtm_id AS VARCHAR), id FROM prescribed WHERE vtm_id IS NOT NULL
        UNION ALL SELECT 'form_route', unnest(form_routes), id FROM prescribed
        UNION ALL SELECT 'bnf', o.value, p.id FROM prescribed p JOIN (SELECT DISTINCT value FROM lookup WHERE facet = 'bnf' AND NOT contains(value, '_')) o
            ON starts_with(p.bnf_code, o.value)""",
}


def lookup(s):
    prescribed, t = s.prescribed, s.table
    return facets.facet_lookup(
        med.catalog_ingredient(prescribed, t("ing"), t("vpi")),
        med.catalog_vtm(prescribed, t("vtm")),
        med.catalog_form_route(prescribed, t("form_route"), t("ont")),
        med.catalog_bnf(prescribed, s.catalogue.codes),
    )


_INDEXES = {}


def index(s):
    """Built once per session, read by several filters."""
    key = (s.spark.sparkContext.applicationId, s.sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = facets.bitmap_index(s.prescribed, lookup(s))
    return _INDEXES[key]


@query("facet_lookup", sql("SELECT facet, value, label, sort_level FROM lookup", **LOOKUP))
def _(s):
    return lookup(s).orderBy("facet", "sort_level", "label", "value")


@query("facet_index", sql("SELECT facet, value, id FROM idx", **LOOKUP))
def _(s):
    return facets.facet_index(s.prescribed, lookup(s))


@query(
    "facet_options",
    sql(
        f"""SELECT DISTINCT value FROM lookup WHERE facet = 'bnf' AND value IN (
              SELECT x.value FROM idx x JOIN prescribed p ON p.id = x.id WHERE x.facet = 'bnf' AND starts_with(p.bnf_code, x.value)
                AND ({INGREDIENT} OR {MOIETY}) AND {INGREDIENT} AND {MOIETY} AND {FORM} AND NOT {OUT})""",
        **LOOKUP,
    ),
)
def _(s):
    return index(s).options(PICKED, "bnf")


@query(
    "facet_options_ingredient",
    sql(
        f"""SELECT DISTINCT value FROM lookup WHERE facet = 'ingredient' AND value IN (
              SELECT CAST(unnest(ingredient_ids) AS VARCHAR) FROM prescribed
              WHERE {LOOSE_CODE} AND {FORM} AND NOT list_contains(ingredient_ids, 7))""",
        **LOOKUP,
    ),
)
def _(s):
    return index(s).options(LOOSE, "ingredient")


@query(
    "medications_grouped",
    sql(
        """SELECT CAST(r.vtm_id AS VARCHAR) AS vtm_id, coalesce(t.nm, 'No VTM') AS vtm_name, g.vtm_status, r.vmp_id, v.nm AS vmp_name,
                  o.vmp_status, r.is_amp, r.id, r.name, r.status
           FROM shown_meds r JOIN own o ON o.vmp_id = r.vmp_id JOIN grouped g ON g.vtm_id IS NOT DISTINCT FROM r.vtm_id
           LEFT JOIN m_vtm t ON t.vtmid = r.vtm_id LEFT JOIN m_vmp v ON v.vpid = r.vmp_id""",
        **LOOSE_TABLES,
        own="""SELECT vtm_id, vmp_id, coalesce(arg_min(status, list_position(['included', 'vmp_not_included_but_child_amp_is', 'not_included', 'excluded'], status)) FILTER (NOT is_amp), 'included') AS vmp_status FROM shown_meds GROUP BY 1, 2""",
        grouped="""SELECT vtm_id, CASE WHEN bool_and(vmp_status = 'excluded') THEN 'excluded'
            WHEN bool_and(vmp_status <> 'included') THEN 'not_included' ELSE 'included' END AS vtm_status FROM own GROUP BY 1""",
    ),
)
def _(s):
    statuses = facets.facet_query(s.prescribed, LOOSE)
    vmps = s.table("vmp").select(F.col("vpid").alias("id"), F.col("nm").alias("name"))
    vtms = s.table("vtm").select(F.col("vtmid").alias("id"), F.col("nm").alias("name"))
    return text(facets.medications_grouped(statuses, vtms, vmps), "vtm_id")
