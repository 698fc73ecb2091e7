"""The domain tables derived from the driver's tables, as SQL both Spark and DuckDB run.

``{name}`` refers to a driver table or an earlier entry. Keys become medicines (part), practices (supplier),
months (shipping dates), items (line items) and patients (orders of the practice's nation).
"""

from __future__ import annotations

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_PRACTICE = "'P' || lpad(CAST(s_suppkey AS STRING), 9, '0')"
_BLOCK = "CAST(floor(s_suppkey / 10) AS BIGINT)"
_PCN = f"'PCN' || lpad(CAST({_BLOCK} AS STRING), 8, '0')"
_NEXT_PCN = f"'PCN' || lpad(CAST({_BLOCK} + 1 AS STRING), 8, '0')"
_NATION = "lpad(CAST(n_nationkey AS STRING), 2, '0')"
_NONE = "CAST(NULL AS STRING)"

MAPPING = {
    # Medicines ---------------------------------------------------------------------------------------------
    "part_code": """
        SELECT p_partkey, p_name, p_type, p_size, p_retailprice,
               CASE p_type WHEN 'ECONOMY' THEN '01' WHEN 'LARGE' THEN '02' WHEN 'MEDIUM' THEN '03'
                           WHEN 'PROMO' THEN '04' WHEN 'SMALL' THEN '05' ELSE '21' END
               || lpad(replace(p_brand, 'Brand#', ''), 2, '0')
               || lpad(CAST(p_size % 10 AS STRING), 2, '0') || '0'
               || chr(CAST(65 + p_size % 26 AS INT)) || '0'
               || CASE WHEN p_partkey % 3 = 0 THEN 'AA' ELSE 'B' || chr(CAST(65 + p_partkey % 26 AS INT)) END
               || 'A' || chr(CAST(65 + p_partkey % 5 AS INT)) || 'A' || chr(CAST(65 + p_partkey % 5 AS INT)) AS bnf_code
        FROM {part}""",
    "bnf_changes": """
        SELECT DISTINCT bnf_code AS old_code, substr(bnf_code, 1, 9) || 'AA' || substr(bnf_code, 12, 4) AS new_code
        FROM {part_code} WHERE p_partkey % 3 <> 0 AND p_size % 9 = 0""",
    "bnf_wide": """
        SELECT 'Chapter ' || substr(bnf_code, 1, 2) AS BNF_CHAPTER, substr(bnf_code, 1, 2) AS BNF_CHAPTER_CODE,
               'Section ' || substr(bnf_code, 1, 4) AS BNF_SECTION, substr(bnf_code, 1, 4) AS BNF_SECTION_CODE,
               'Paragraph ' || substr(bnf_code, 1, 6) AS BNF_PARAGRAPH, substr(bnf_code, 1, 6) AS BNF_PARAGRAPH_CODE,
               'Subparagraph ' || substr(bnf_code, 1, 7) AS BNF_SUBPARAGRAPH,
               substr(bnf_code, 1, 7) AS BNF_SUBPARAGRAPH_CODE,
               CASE WHEN p_size % 10 = 5 THEN 'Subparagraph ' || substr(bnf_code, 1, 7)
                    ELSE 'Chemical ' || substr(bnf_code, 1, 9) END AS BNF_CHEMICAL_SUBSTANCE,
               CASE WHEN p_size % 10 = 5 THEN substr(bnf_code, 1, 7)
                    ELSE substr(bnf_code, 1, 9) END AS BNF_CHEMICAL_SUBSTANCE_CODE,
               'Product ' || substr(bnf_code, 1, 11) AS BNF_PRODUCT, substr(bnf_code, 1, 11) AS BNF_PRODUCT_CODE,
               CASE WHEN substr(bnf_code, 10, 2) = 'AA' AND substr(bnf_code, 15, 1) IN ('A', 'C')
                    THEN 'Generic ' ELSE '' END || 'Presentation ' || bnf_code AS BNF_PRESENTATION,
               CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE bnf_code END AS BNF_PRESENTATION_CODE
        FROM {part_code}""",
    "vmp": """
        SELECT p_partkey AS vpid, p_name AS nm,
               CAST(CASE WHEN p_size % 26 = 0 THEN NULL ELSE 1000 + p_size % 26 END AS BIGINT) AS vtmid,
               p_partkey % 41 = 0 AS invalid,
               CASE WHEN CAST(floor(p_partkey / 3) AS BIGINT) % 5 <> 0 THEN p_partkey - 3 END AS vpidprev
        FROM {part} WHERE p_partkey % 3 = 0""",
    "amp": """
        SELECT p_partkey AS apid, p_partkey - p_partkey % 3 AS vpid,
               p_name || ' (Maker ' || CAST(p_size AS STRING) || ')' AS descr, p_partkey % 43 = 0 AS invalid
        FROM {part} WHERE p_partkey % 3 <> 0""",
    "code_map": """
        SELECT p_partkey AS dmd_id, bnf_code FROM {part_code} WHERE p_partkey % 17 <> 0
        UNION ALL
        SELECT p_partkey, substr(bnf_code, 1, 9) || 'AA' || substr(bnf_code, 14, 2) || substr(bnf_code, 14, 2)
        FROM {part_code} WHERE p_partkey % 31 = 0""",
    "part_form": """
        SELECT p_partkey, p_size, split_part(p_name, ' ', 2) || '.' || split_part(p_name, ' ', 1) AS descr
        FROM {part}""",
    "form_route": "SELECT min(p_partkey) AS cd, descr FROM {part_form} GROUP BY descr",
    "ont": """
        SELECT DISTINCT p_partkey - p_partkey % 3 AS vpid, f.cd AS formcd
        FROM {part_form} p JOIN {form_route} f ON p.descr = f.descr WHERE p_size % 11 <> 0""",
    "vpi": """
        SELECT p_partkey AS vpid, CAST(p_size AS BIGINT) AS isid FROM {part}
        WHERE p_partkey % 3 = 0 AND p_size % 13 <> 0
        UNION ALL
        SELECT p_partkey, CAST(100 + p_size % 7 AS BIGINT) FROM {part}
        WHERE p_partkey % 3 = 0 AND p_size % 13 <> 0""",
    "ing": "SELECT DISTINCT isid, 'Ingredient ' || CAST(isid AS STRING) AS nm FROM {vpi}",
    "vtm": "SELECT DISTINCT vtmid, 'Moiety ' || CAST(vtmid AS STRING) AS nm FROM {vmp} WHERE vtmid IS NOT NULL",
    # Prescribing -------------------------------------------------------------------------------------------
    # Practice '-' is unattributed; practices ending in 7 stopped in 1999.
    "facts": """
        SELECT l_partkey AS presentation_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               CASE WHEN l_suppkey % 50 = 49 OR (l_suppkey % 10 = 7 AND CAST(l_shipdate AS DATE) >= DATE '1999-01-01')
                    THEN '-' ELSE 'P' || lpad(CAST(l_suppkey AS STRING), 9, '0') END AS practice_code,
               l_quantity / 2 AS quantity_value, CAST(l_quantity AS INT) AS items, l_quantity * 28 AS quantity,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS net_cost,
               CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(l_quantity AS INT) AS actual_cost
        FROM {lineitem}""",
    "source": """
        SELECT c.bnf_code, CASE WHEN f.presentation_id % 19 = 0 THEN 0 ELSE f.presentation_id END AS snomed_code,
               f.date, f.practice_code, f.quantity_value, f.items, f.quantity, f.net_cost, f.actual_cost
        FROM {facts} f JOIN {part_code} c ON f.presentation_id = c.p_partkey""",
    "nation_months": """
        SELECT c.c_nationkey AS nationkey, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS date, count(*) AS n
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
    # At most 25 nations x 256 months on the broadcast side.
    "list_raw": f"""
        SELECT /*+ BROADCAST(m) */ m.date, {_PRACTICE} AS ORG_CODE,
               CAST(m.n + s.s_suppkey % 7 AS STRING) AS NUMBER_OF_PATIENTS,
               'GP' AS ORG_TYPE, 'ALL' AS SEX, 'ALL' AS AGE_GROUP_5
        FROM {{supplier}} s JOIN {{nation_months}} m ON s.s_nationkey = m.nationkey
        UNION ALL
        SELECT /*+ BROADCAST(m) */ m.date, {_PRACTICE}, CAST(m.n AS STRING), 'GP', 'MALE', 'ALL'
        FROM {{supplier}} s JOIN {{nation_months}} m ON s.s_nationkey = m.nationkey WHERE s_suppkey % 2 = 0""",
    # Organisations -----------------------------------------------------------------------------------------
    "partner_rel": f"""
        SELECT {_PRACTICE} AS source, {_PCN} AS pcn, '2013-04-01' AS op_start,
               CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE '2030-12-31' END AS op_end
        FROM {{supplier}} WHERE s_suppkey % 5 = 0
        UNION ALL
        SELECT {_PRACTICE}, {_NEXT_PCN}, '2019-07-01', CASE WHEN s_suppkey % 20 = 0 THEN '2019-12-31' ELSE '' END
        FROM {{supplier}} WHERE s_suppkey % 5 = 0""",
    "ods": f"""
        SELECT 'REG' || CAST(r_regionkey AS STRING) AS id, r_name AS name, false AS inactive, 'RO209' AS primary_role,
               'NHS ENGLAND (REGION)' AS primary_name, 'NHS ENGLAND (REGION)' AS role, {_NONE} AS partner1,
               {_NONE} AS partner2, {_NONE} AS re4, {_NONE} AS icb, {_NONE} AS nhser, 'ENGLAND' AS country
        FROM {{region}}
        UNION ALL
        SELECT 'ICB' || {_NATION}, n_name, false, 'RO261', 'STRATEGIC PARTNERSHIP', 'INTEGRATED CARE BOARD', NULL,
               NULL, NULL, NULL, 'REG' || CAST(n_regionkey AS STRING), 'ENGLAND' FROM {{nation}}
        UNION ALL
        SELECT 'SIC' || {_NATION}, n_name || ' sub', false, 'RO98', 'CLINICAL GROUP', 'SUB ICB LOCATION', NULL, NULL,
               NULL, 'ICB' || {_NATION}, 'REG' || CAST(n_regionkey AS STRING), 'ENGLAND' FROM {{nation}}
        UNION ALL
        SELECT {_PCN}, 'Network ' || s_name, false, 'RO272', 'PRIMARY CARE NETWORK', 'PRIMARY CARE NETWORK', NULL, NULL,
               'SIC' || {_NATION}, 'ICB' || {_NATION}, NULL, 'ENGLAND'
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey WHERE s_suppkey % 10 = 0
        UNION ALL
        SELECT {_PRACTICE}, s_name, s_suppkey % 17 = 0, 'RO177', 'PRESCRIBING COST CENTRE',
               CASE WHEN s_acctbal < 0 OR s_suppkey % 10 = 8 THEN 'WALK-IN CENTRE' ELSE 'GP PRACTICE' END, {_PCN},
               CASE WHEN s_suppkey % 5 = 0 THEN {_NEXT_PCN} END,
               'SIC' || {_NATION}, 'ICB' || {_NATION}, 'REG' || CAST(n_regionkey AS STRING),
               CASE WHEN s_suppkey % 23 = 22 THEN 'WALES' ELSE 'ENGLAND' END
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey""",
    # Downloads ---------------------------------------------------------------------------------------------
    "downloads": """
        SELECT CASE WHEN event_id % 97 = 0 THEN '.' ELSE '' END || 'prescribing_' || CAST(CAST(ts AS DATE) AS STRING)
               || '_v' || CAST(event_id % 3 AS STRING) || '_' || event_type || '.parquet' AS name,
               event_type AS dataset, CAST(ts AS DATE) AS day, event_id
        FROM {events}""",
    "yearly_changes": """
        SELECT 2000 + p_partkey % 5 AS year, p_partkey AS line, 'C' || CAST(p_partkey AS STRING) AS old,
               'C' || CAST(p_partkey + 1 AS STRING) AS new
        FROM {part} WHERE p_partkey % 5 < 4
        UNION ALL
        SELECT 1999, p_partkey, 'C' || CAST(p_partkey AS STRING), 'X' || CAST(p_partkey AS STRING)
        FROM {part} WHERE p_partkey % 7 = 0""",
    "tariff_raw": """
        SELECT CAST('2024-0' || CAST(1 + p_partkey % 3 AS STRING) || '-01' AS DATE) AS date, p_name AS Medicine,
               CAST(p_partkey AS STRING) AS vmpp,
               'Part VIIIA ' || CASE p_type WHEN 'ECONOMY' THEN 'Category A' WHEN 'LARGE' THEN 'Category C'
                                            WHEN 'MEDIUM' THEN 'Category H' ELSE 'Category M' END AS category,
               CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN ''
                    ELSE CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING) END AS price
        FROM {part}""",
}


def references(sql: str) -> list[str]:
    return [n for n in (*DRIVER_TABLES, *MAPPING) if "{" + n + "}" in sql]


def duckdb_ctes() -> str:
    """The whole mapping as a WITH list for DuckDB (driver tables are views of the same name)."""
    names = {n: n for n in DRIVER_TABLES} | {n: f"m_{n}" for n in MAPPING}
    return ",\n".join(f"m_{name} AS ({sql.format(**names)})" for name, sql in MAPPING.items())
