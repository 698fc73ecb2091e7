"""SQL building blocks of the DuckDB side: the mapping plus the derived tables most checks share."""

from __future__ import annotations

from checks.mapping import duckdb_ctes

_LEVELS = ("CHAPTER", "SECTION", "PARAGRAPH", "SUBPARAGRAPH", "CHEMICAL_SUBSTANCE", "PRODUCT", "PRESENTATION")
_WIDE = " UNION ALL ".join(
    f"SELECT BNF_{name}_CODE AS code, BNF_{name} AS name, {i} AS level FROM m_bnf_wide" for i, name in enumerate(_LEVELS, start=1)
)

SHARED = {
    "codes": f"SELECT code, name, CAST(min(level) AS INTEGER) AS level FROM ({_WIDE}) "
    "WHERE code IS NOT NULL AND name IS NOT NULL GROUP BY code, name",
    "pres": "SELECT code, name FROM codes WHERE level = 7",
    "meds": """
        SELECT p.id, c.bnf_code, p.name, p.is_amp, p.vmp_id, p.vtm_id, p.invalid,
               coalesce(f.fr, CAST([] AS VARCHAR[])) AS form_routes, coalesce(i.ing, CAST([] AS BIGINT[])) AS ingredient_ids
        FROM (SELECT vpid AS id, nm AS name, false AS is_amp, vpid AS vmp_id, vtmid AS vtm_id, invalid FROM m_vmp
              UNION ALL
              SELECT a.apid, a.descr, true, v.vpid, v.vtmid, a.invalid FROM m_amp a JOIN m_vmp v ON a.vpid = v.vpid) p
        LEFT JOIN m_code_map c ON c.dmd_id = p.id
        LEFT JOIN (SELECT o.vpid, list(f.descr ORDER BY f.descr) AS fr FROM m_ont o
                   JOIN m_form_route f ON o.formcd = f.cd GROUP BY 1) f ON f.vpid = p.vmp_id
        LEFT JOIN (SELECT vpid, list(isid ORDER BY isid) AS ing FROM m_vpi GROUP BY 1) i ON i.vpid = p.vmp_id""",
    "presentations": "SELECT bnf_code, snomed_code, max(date) AS last FROM m_source GROUP BY 1, 2",
    "recent": "SELECT DISTINCT bnf_code FROM presentations WHERE last > DATE '2001-09-01'",
    "prescribed": """
        SELECT * FROM meds WHERE bnf_code IN (SELECT bnf_code FROM recent)
           OR (NOT is_amp AND id IN (SELECT vmp_id FROM meds WHERE is_amp AND bnf_code IN (SELECT bnf_code FROM recent)))""",
    "cur": "SELECT p_partkey AS id, coalesce(new_code, bnf_code) AS bnf_code FROM m_part_code "
    "LEFT JOIN m_bnf_changes ON old_code = bnf_code",
    "rx": "SELECT f.*, c.bnf_code FROM m_facts f JOIN cur c ON f.presentation_id = c.id WHERE practice_code <> '-'",
    "dates": "SELECT DISTINCT date FROM m_facts",
    "practices": "SELECT practice_code AS code, max(date) AS latest FROM m_facts WHERE practice_code <> '-' GROUP BY 1",
    "lists": "SELECT date, ORG_CODE AS practice_code, CAST(NUMBER_OF_PATIENTS AS BIGINT) AS total FROM m_list_raw WHERE SEX = 'ALL'",
    "orgs": """
        SELECT 'ENGLAND' AS id, 'nat' AS org_type, 'NHS England' AS name, false AS inactive, 1 AS rank
        UNION ALL
        SELECT id, t, name, inactive, list_position(['nat', 'reg', 'icb', 'sic', 'pcn', 'pra', 'oth'], t)
        FROM (SELECT *, CASE WHEN primary_name = 'NHS ENGLAND (REGION)' THEN 'reg'
                             WHEN role = 'INTEGRATED CARE BOARD' THEN 'icb'
                             WHEN role = 'SUB ICB LOCATION' THEN 'sic'
                             WHEN primary_name = 'PRIMARY CARE NETWORK' THEN 'pcn'
                             WHEN role = 'GP PRACTICE' THEN 'pra' ELSE 'oth' END AS t
              FROM m_ods WHERE country = 'ENGLAND')""",
    "as_of": """
        SELECT r.source AS id, arg_max(r.pcn, r.op_start) AS pcn_id
        FROM m_partner_rel r JOIN m_ods o ON o.id = r.pcn
        WHERE r.op_start <= '2020-01-01' AND (r.op_end >= '2020-01-01' OR r.op_end = '') GROUP BY 1""",
    "candidates": """
        SELECT id, unnest([re4, icb, nhser]) AS pid FROM m_ods
        UNION ALL SELECT id, partner1 FROM m_ods WHERE partner2 IS NULL
        UNION ALL SELECT o.id, a.pcn_id FROM m_ods o JOIN as_of a ON a.id = o.id WHERE o.partner2 IS NOT NULL""",
    "edges": """
        SELECT id AS child_id, 'ENGLAND' AS parent_id FROM orgs WHERE org_type <> 'nat'
        UNION
        SELECT c.id, p.id FROM candidates x JOIN orgs c ON c.id = x.id JOIN orgs p ON p.id = x.pid
        WHERE p.org_type <> 'nat' AND p.rank < c.rank""",
    "members": """
        SELECT o.id AS org_id, o.org_type, m.practice_code
        FROM orgs o LEFT JOIN (
            SELECT e.parent_id AS org_id, e.child_id AS practice_code FROM edges e JOIN orgs c ON c.id = e.child_id
            WHERE c.org_type = 'pra'
            UNION ALL SELECT id, id FROM orgs WHERE org_type = 'pra') m ON m.org_id = o.id""",
}


def sql(body: str, **extra: str) -> str:
    """A check: mapping, shared tables, the given extra tables, then the query."""
    shared = ",\n".join(f"{name} AS ({text})" for name, text in (SHARED | extra).items())
    return f"WITH {duckdb_ctes()},\n{shared}\n{body}"


def codes_where(condition: str) -> str:
    return f"SELECT code FROM pres WHERE {condition}"


def of_medications(condition: str) -> str:
    return f"code IN (SELECT bnf_code FROM meds WHERE bnf_code IS NOT NULL AND ({condition}))"


def ratio_tables(num: str, den: str | None, org_type: str, months: int) -> dict[str, str]:
    """Tables num_codes .. odm (org_id, date, num, den, value) of one analysis."""
    if den is None:
        den_sql = "SELECT practice_code, date, total AS v FROM lists WHERE practice_code IN (SELECT code FROM active)"
        times = 1000
    else:
        den_sql = f"SELECT practice_code, date, items AS v FROM rx WHERE bnf_code IN ({den})"
        times = 100
    return {
        "win": f"SELECT date FROM dates ORDER BY date DESC LIMIT {months}",
        "active": "SELECT code FROM practices WHERE latest >= (SELECT min(date) FROM win)",
        "mem": f"SELECT org_id, practice_code FROM members WHERE org_type = '{org_type}'",
        "grid": f"SELECT o.id AS org_id, w.date FROM orgs o CROSS JOIN win w WHERE o.org_type = '{org_type}'",
        "num_sums": f"SELECT m.org_id, date, sum(items) AS v FROM rx JOIN mem m USING (practice_code) WHERE bnf_code IN ({num}) GROUP BY 1, 2",
        "den_sums": f"SELECT m.org_id, date, sum(v) AS v FROM ({den_sql}) d JOIN mem m USING (practice_code) GROUP BY 1, 2",
        "odm": f"""SELECT g.org_id, g.date, CAST(coalesce(n.v, 0) AS BIGINT) AS num, CAST(coalesce(d.v, 0) AS BIGINT) AS den,
                CASE WHEN coalesce(d.v, 0) <> 0 THEN CAST(coalesce(n.v, 0) AS DOUBLE) / CAST(d.v AS DOUBLE) * {times} END AS value
            FROM grid g LEFT JOIN num_sums n ON n.org_id = g.org_id AND n.date = g.date
            LEFT JOIN den_sums d ON d.org_id = g.org_id AND d.date = g.date""",
    }


def centiles_sql(table: str, keys: str = "date") -> str:
    cs = ", ".join(str(c / 100) for c in range(10, 100, 10))
    return f"""SELECT {keys}, unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) AS centile, unnest(q) AS value
        FROM (SELECT {keys}, coalesce(quantile_cont(value, [{cs}]), [NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS q
              FROM {table} GROUP BY {keys})"""
