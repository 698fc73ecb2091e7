"""Dimensions, normalised tables, views, code chains, organisations and medicine catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle import sql
from checks.registry import query, text
from checks.sample import AS_OF
from checks.source_queries import IDS, NORM, norm
from scriptline.operators import chains, orgs, star
from scriptline.operators import medications as med


@query("date_dim", sql("SELECT id, CAST(date AS VARCHAR) AS date FROM date_ids", **IDS))
def _(s):
    return text(star.date_dim(s.source), "date")


@query("practice_dim", sql("SELECT id, code, CAST(latest AS VARCHAR) AS latest_prescribing_date FROM practice", **IDS))
def _(s):
    return text(star.practice_dim(s.source), "latest_prescribing_date")


@query("presentation_dim", sql("SELECT id, bnf_code, snomed_code, CAST(last AS VARCHAR) AS last_prescribed_date FROM presentation", **IDS))
def _(s):
    return text(star.presentation_dim(s.source), "last_prescribed_date")


@query("prescribing_norm", sql(NORM, **IDS))
def _(s):
    return norm(s)


@query(
    "bnf_code_ranges",
    sql(
        """SELECT CAST(floor(n / 100) AS BIGINT) AS batch, min(code) AS start, coalesce(any_value(stop), 'ZZZZZZZZZZZZZZZ') AS "end"
           FROM (SELECT n, bnf_code AS code, (SELECT min(x.bnf_code) FROM numbered x WHERE x.n = (floor(y.n / 100) + 1) * 100) AS stop
                 FROM numbered y) GROUP BY 1""",
        numbered="SELECT row_number() OVER (ORDER BY bnf_code) - 1 AS n, bnf_code FROM (SELECT DISTINCT bnf_code FROM presentations)",
    ),
)
def _(s):
    return star.bnf_code_ranges(star.presentations(s.source), 100)


LIST_NORM = "SELECT d.id AS date_id, r.id AS practice_id, total FROM lists l JOIN date_ids d ON d.date = l.date JOIN practice r ON r.code = l.practice_code"


@query("list_size_norm", sql(LIST_NORM, **IDS))
def _(s):
    return star.list_size_norm(s.list_sizes, star.date_dim(s.source), star.practice_dim(s.source))


CURRENT = {
    "vmp_changes": """SELECT vpidprev AS old_vpid,
            3 * least(5 * CAST(floor(vpid / 15) AS BIGINT) + 4, (SELECT max(vpid) / 3 FROM m_vmp)) AS new_vpid
        FROM m_vmp WHERE vpidprev IS NOT NULL""",
    "current_codes": """SELECT p.id, coalesce(b.new_code, p.bnf_code) AS bnf_code, p.bnf_code AS original_bnf_code,
            CAST(coalesce(v.new_vpid, p.snomed_code) AS BIGINT) AS snomed_code, p.snomed_code AS original_snomed_code,
            CAST(p.last AS VARCHAR) AS last_prescribed_date
        FROM presentation p LEFT JOIN m_bnf_changes b ON b.old_code = p.bnf_code
        LEFT JOIN vmp_changes v ON v.old_vpid = p.snomed_code""",
}


def current(s):
    return star.presentation_current_codes(
        star.presentation_dim(s.source), s.table("bnf_changes"), chains.vmp_code_change_chain(s.table("vmp"))
    )


@query("presentation_current_codes", sql("SELECT * FROM current_codes", **IDS, **CURRENT))
def _(s):
    return text(current(s), "last_prescribed_date")


@query(
    "prescribing_view",
    sql(
        f"""SELECT n.presentation_id, c.bnf_code, c.snomed_code, n.date_id, CAST(d.date AS VARCHAR) AS date, n.practice_id,
                   r.code AS practice_code, quantity_value, items, quantity, net_cost, actual_cost
            FROM ({NORM}) n JOIN current_codes c ON c.id = n.presentation_id JOIN date_ids d ON d.id = n.date_id
            JOIN practice r ON r.id = n.practice_id""",
        **IDS,
        **CURRENT,
    ),
)
def _(s):
    dates, practices = star.date_dim(s.source), star.practice_dim(s.source)
    presentation = current(s)
    original = presentation.select("id", F.col("original_bnf_code").alias("bnf_code"), F.col("original_snomed_code").alias("snomed_code"))
    fact = star.prescribing_norm(s.source, dates, practices, original)
    return text(star.prescribing_view(fact, presentation, dates, practices), "date")


@query(
    "list_size_view",
    sql(
        f"""SELECT n.date_id, CAST(d.date AS VARCHAR) AS date, n.practice_id, r.code AS practice_code, n.total
            FROM ({LIST_NORM}) n JOIN date_ids d ON d.id = n.date_id JOIN practice r ON r.id = n.practice_id""",
        **IDS,
    ),
)
def _(s):
    dates, practices = star.date_dim(s.source), star.practice_dim(s.source)
    return text(star.list_size_view(star.list_size_norm(s.list_sizes, dates, practices), dates, practices), "date")


@query(
    "bnf_code_change_chain",
    sql("""SELECT 'C' || CAST(p_partkey AS VARCHAR) AS old_code,
                  CASE WHEN p_partkey % 7 = 0 THEN 'X' || CAST(p_partkey AS VARCHAR)
                       ELSE 'C' || CAST(p_partkey - p_partkey % 5 + 4 AS VARCHAR) END AS new_code
           FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 < 4"""),
)
def _(s):
    return chains.bnf_code_change_chain(s.table("yearly_changes"))


@query("vmp_code_change_chain", sql("SELECT old_vpid, CAST(new_vpid AS BIGINT) AS new_vpid FROM vmp_changes", **CURRENT | {"current_codes": "SELECT 1"}))
def _(s):
    return chains.vmp_code_change_chain(s.table("vmp"))


@query("org_classify", sql("SELECT id, org_type, name, inactive FROM orgs"))
def _(s):
    return s.orgs


@query("org_parents", sql("SELECT child_id, parent_id FROM edges"))
def _(s):
    return s.org_edges


@query("org_partner_as_of", sql("SELECT id, pcn_id FROM as_of"))
def _(s):
    return orgs.org_partner_as_of(s.ods, AS_OF)


@query("org_verify", sql("SELECT org_type, count(*) AS n FROM orgs GROUP BY 1"))
def _(s):
    return orgs.org_verify(s.orgs)


@query("org_practices", sql("SELECT org_id, org_type, practice_code FROM members"))
def _(s):
    return orgs.org_practices(s.orgs, s.org_edges)


@query("orgs_ordered", sql("SELECT id, name, org_type FROM orgs ORDER BY rank, name, id"))
def _(s):
    return orgs.orgs_ordered(s.orgs)


MED_COLUMNS = """id, bnf_code, name, is_amp, vmp_id, CAST(vtm_id AS VARCHAR) AS vtm_id, invalid,
                 array_to_string(form_routes, ',') AS form_routes, array_to_string(ingredient_ids, ',') AS ingredient_ids"""


def flat(meds):
    """Medications with lists as text."""
    ids = F.array_join(F.col("ingredient_ids").cast("array<string>"), ",")
    return text(meds, "vtm_id").withColumn("form_routes", F.array_join("form_routes", ",")).withColumn("ingredient_ids", ids)


@query("medications", sql(f"SELECT {MED_COLUMNS} FROM meds"))
def _(s):
    return flat(s.medications)


@query("presentations_recent", sql("SELECT bnf_code FROM recent"))
def _(s):
    return med.presentations_recent(star.presentations(s.source), "2001-09-01")


@query("medications_prescribed", sql(f"SELECT {MED_COLUMNS} FROM prescribed"))
def _(s):
    return flat(s.prescribed)


@query("catalog_vtm", sql("SELECT vtmid AS id, nm AS name FROM m_vtm WHERE vtmid IN (SELECT vtm_id FROM prescribed)"))
def _(s):
    return med.catalog_vtm(s.prescribed, s.table("vtm"))


@query("catalog_vmp", sql("SELECT id, CAST(vtm_id AS VARCHAR) AS vtm_id, name FROM prescribed WHERE NOT is_amp"))
def _(s):
    return text(med.catalog_vmp(s.prescribed), "vtm_id")


@query("catalog_amp", sql("SELECT id, vmp_id, name FROM prescribed WHERE is_amp"))
def _(s):
    return med.catalog_amp(s.prescribed)


@query(
    "catalog_ingredient",
    sql("""SELECT DISTINCT i.isid AS id, i.nm AS name FROM m_ing i JOIN m_vpi v ON v.isid = i.isid
           WHERE v.vpid IN (SELECT vmp_id FROM prescribed)"""),
)
def _(s):
    return med.catalog_ingredient(s.prescribed, s.table("ing"), s.table("vpi"))


@query(
    "catalog_form_route",
    sql("""SELECT DISTINCT f.cd AS id, f.descr FROM m_form_route f JOIN m_ont o ON o.formcd = f.cd
           WHERE o.vpid IN (SELECT vmp_id FROM prescribed)"""),
)
def _(s):
    return med.catalog_form_route(s.prescribed, s.table("form_route"), s.table("ont"))


SHOWN = {
    "shown": "SELECT code, level, name FROM codes WHERE level = 7 AND code NOT LIKE '2%' AND code IN (SELECT bnf_code FROM prescribed)",
    "cat_bnf": """SELECT code, level, name FROM codes WHERE code IN (SELECT substr(code, 1, n) FROM shown, (SELECT unnest([2, 4, 6, 7, 9]) AS n))
        UNION ALL
        SELECT substr(code, 1, 9) || '_' || right(code, 2), 6, CASE WHEN starts_with(name, 'Generic ') THEN substr(name, 9) ELSE name END
        FROM codes WHERE code IN (SELECT substr(code, 1, 9) || 'AA' || right(code, 2) || right(code, 2) FROM shown)
        UNION ALL SELECT code, level, name FROM shown""",
}


@query("catalog_bnf", sql("SELECT code, CAST(level AS INTEGER) AS level, name FROM cat_bnf", **SHOWN))
def _(s):
    return med.catalog_bnf(s.prescribed, s.codes)
