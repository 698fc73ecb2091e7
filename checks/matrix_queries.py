"""Matrices, ratios, centiles, measures and hierarchy reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.filter_queries import BRIDGE, GENERIC, MEASURES, WHOLE, WHOLE_SQL
from checks.oracle import centiles_sql, codes_where, ratio_tables, sql
from checks.registry import query, rounded, text
from scriptline.operators import dense, hierarchy
from scriptline.operators.measures import OUTPUT_VALUES
from scriptline.operators.medicine_filter import MedicineFilter
from scriptline.plans import analysis
from scriptline.plans.analysis import Analysis
from scriptline.session import new_path

MONTHS = 24
LISTED = MedicineFilter(bnf_codes=("01", "0203", "05"))
LISTED_CODES = codes_where("starts_with(code, '01') OR starts_with(code, '0203') OR starts_with(code, '05')")
WIN = {
    "win": f"SELECT date FROM dates ORDER BY date DESC LIMIT {MONTHS}",
    "active": "SELECT code FROM practices WHERE latest >= (SELECT min(date) FROM win)",
    "pdm": f"""SELECT a.code AS practice_code, w.date, CAST(coalesce(x.v, 0) AS BIGINT) AS value FROM active a CROSS JOIN win w
        LEFT JOIN (SELECT practice_code, date, sum(items) AS v FROM rx WHERE bnf_code IN ({LISTED_CODES}) GROUP BY 1, 2) x
        ON x.practice_code = a.code AND x.date = w.date""",
    "lists_pdm": """SELECT a.code AS practice_code, w.date, CAST(coalesce(x.v, 0) AS BIGINT) AS value FROM active a CROSS JOIN win w
        LEFT JOIN (SELECT practice_code, date, sum(total) AS v FROM lists GROUP BY 1, 2) x
        ON x.practice_code = a.code AND x.date = w.date""",
    "msums": f"SELECT bnf_code, date, sum(items) AS v FROM rx WHERE bnf_code IN ({LISTED_CODES}) AND date IN (SELECT date FROM win) GROUP BY 1, 2",
    "mdm": """SELECT c.bnf_code, w.date, CAST(coalesce(x.v, 0) AS BIGINT) AS value
        FROM (SELECT DISTINCT bnf_code FROM msums WHERE v <> 0) c CROSS JOIN win w
        LEFT JOIN msums x ON x.bnf_code = c.bnf_code AND x.date = w.date""",
}


@query("recent_dates", sql("SELECT CAST(date AS VARCHAR) AS date FROM win", **WIN))
def _(s):
    return text(dense.recent_dates(s.model.dates, MONTHS), "date")


@query("active_practices", sql("SELECT code, CAST(latest AS VARCHAR) AS latest_prescribing_date FROM practices WHERE code IN (SELECT code FROM active)", **WIN))
def _(s):
    return text(dense.active_practices(s.model.practices, dense.recent_dates(s.model.dates, MONTHS)), "latest_prescribing_date")


@query(
    "grouped_sum",
    sql("""SELECT practice_code, CAST(date AS VARCHAR) AS date, CAST(sum(items) AS BIGINT) AS items, sum(quantity) AS quantity
           FROM m_source GROUP BY 1, 2"""),
)
def _(s):
    return text(dense.grouped_sum(s.source, ["practice_code", "date"], ["items", "quantity"]), "date")


@query("practice_date_matrix", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value FROM pdm", **WIN))
def _(s):
    return text(analysis.practice_date_matrix(s.model, LISTED, MONTHS), "date")


@query("practice_list_size_matrix", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value FROM lists_pdm", **WIN))
def _(s):
    return text(analysis.practice_date_matrix(s.model, None, MONTHS), "date")


@query("medication_date_matrix", sql("SELECT bnf_code, CAST(date AS VARCHAR) AS date, value FROM mdm", **WIN))
def _(s):
    return text(analysis.medication_date_matrix(s.model, LISTED, MONTHS), "date")


GROUPED = """SELECT g.org_id, CAST(w.date AS VARCHAR) AS date, CAST(coalesce(x.v, 0) AS BIGINT) AS value
    FROM (SELECT DISTINCT org_id FROM members WHERE org_type = 'icb') g CROSS JOIN win w
    LEFT JOIN (SELECT m.org_id, p.date, sum(value) AS v FROM pdm p JOIN members m ON m.practice_code = p.practice_code
               WHERE m.org_type = 'icb' GROUP BY 1, 2) x ON x.org_id = g.org_id AND x.date = w.date"""


@query("group_rows", sql(GROUPED, **WIN))
def _(s):
    matrix = analysis.practice_date_matrix(s.model, LISTED, MONTHS)
    months = dense.recent_dates(s.model.dates, MONTHS)
    members = s.model.members.where("org_type = 'icb'").select("org_id", "practice_code")
    return text(dense.group_rows(matrix, "practice_code", members, "org_id", months), "date")


@query("matrix_scale", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value * 0.5 AS value FROM (SELECT practice_code, date, CAST(value AS DOUBLE) AS value FROM pdm)", **WIN))
def _(s):
    return text(dense.scale(analysis.practice_date_matrix(s.model, LISTED, MONTHS), 0.5), "date")


@query(
    "matrix_divide",
    sql("""SELECT p.practice_code, CAST(p.date AS VARCHAR) AS date,
                  round(CASE WHEN l.value <> 0 THEN CAST(p.value AS DOUBLE) / l.value END, 6) AS value
           FROM pdm p JOIN lists_pdm l ON l.practice_code = p.practice_code AND l.date = p.date""", **WIN),
)
def _(s):
    top, below = (analysis.practice_date_matrix(s.model, q, MONTHS) for q in (LISTED, None))
    return text(rounded(dense.divide(top, below, "practice_code"), "value"), "date")


@query("matrix_row", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value FROM pdm WHERE practice_code = 'P000000003'", **WIN))
def _(s):
    return text(dense.matrix_row(analysis.practice_date_matrix(s.model, LISTED, MONTHS), "practice_code", "P000000003"), "date")


@query("matrix_records", sql("SELECT bnf_code AS medication, CAST(date AS VARCHAR) AS month, value AS items FROM mdm", **WIN))
def _(s):
    return text(dense.records(analysis.medication_date_matrix(s.model, LISTED, MONTHS), "bnf_code", "medication", "month", "items"), "month")


@query("drop_zero_rows", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value FROM pdm WHERE practice_code IN (SELECT practice_code FROM pdm WHERE value <> 0)", **WIN))
def _(s):
    return text(dense.drop_zero_rows(analysis.practice_date_matrix(s.model, LISTED, MONTHS), "practice_code"), "date")


@query("centiles", sql(f"SELECT centile, CAST(date AS VARCHAR) AS date, round(value, 6) AS value FROM ({centiles_sql('pdm')})", **WIN))
def _(s):
    return rounded(text(dense.centiles(analysis.practice_date_matrix(s.model, LISTED, MONTHS)), "date"), "value")


@query(
    "missing_to_null",
    sql("""SELECT practice_code, CAST(date AS VARCHAR) AS date,
                  CASE WHEN value <> 0 THEN round(CAST(value AS DOUBLE) / value, 6) END AS value FROM pdm""", **WIN),
)
def _(s):
    matrix = analysis.practice_date_matrix(s.model, LISTED, MONTHS)
    share = F.when(F.col("value") == 0, F.lit(float("nan"))).otherwise(F.col("value") / F.col("value"))
    return text(matrix.withColumn("value", dense.missing_to_null(share)), "date")


# Analyses -------------------------------------------------------------------------------------------------
PER_PATIENT = Analysis(LISTED)
PER_ITEM = Analysis(MedicineFilter(bnf_codes=("01", "02"), product_type="generic"), MedicineFilter(bnf_codes=("01", "02")))
PCN_PER_ITEM = Analysis(WHOLE, MedicineFilter(bnf_codes=("01", "02", "03")), org_id="SIC03")
PER_ITEM_TABLES = ratio_tables(
    codes_where(f"(starts_with(code, '01') OR starts_with(code, '02')) AND {GENERIC}"),
    codes_where("starts_with(code, '01') OR starts_with(code, '02')"), "icb", 96,
)
PER_PATIENT_TABLES = ratio_tables(LISTED_CODES, None, "icb", 96)
SIC_TABLES = ratio_tables(
    codes_where(WHOLE_SQL), codes_where("starts_with(code, '01') OR starts_with(code, '02') OR starts_with(code, '03')"), "sic", 96
)
ODM = "SELECT org_id, CAST(date AS VARCHAR) AS date, round(value, 6) AS value FROM odm"


@query("org_date_ratio", sql(ODM, **PER_ITEM_TABLES))
def _(s):
    return rounded(text(analysis.org_date_ratio(s.model, PER_ITEM), "date"), "value")


@query("org_date_ratio_patients", sql(ODM, **PER_PATIENT_TABLES))
def _(s):
    return rounded(text(analysis.org_date_ratio(s.model, PER_PATIENT), "date"), "value")


@query("all_orgs", sql("SELECT org_id AS org, CAST(date AS VARCHAR) AS month, round(value, 6) AS value FROM odm", **SIC_TABLES))
def _(s):
    return rounded(text(analysis.all_orgs(s.model, PCN_PER_ITEM), "month"), "value")


@query("org_series", sql("SELECT CAST(date AS VARCHAR) AS month, round(value, 6) AS value FROM odm WHERE org_id = 'SIC03'", **SIC_TABLES))
def _(s):
    return rounded(text(analysis.org_series(s.model, PCN_PER_ITEM), "month"), "value")


@query("deciles", sql(f"SELECT centile, CAST(date AS VARCHAR) AS month, round(value, 6) AS value FROM ({centiles_sql('odm')})", **PER_ITEM_TABLES))
def _(s):
    return rounded(text(analysis.deciles(s.model, PER_ITEM), "month"), "value")


@query(
    "deciles_patients",
    sql(f"SELECT centile, CAST(date AS VARCHAR) AS month, round(value, 6) AS value FROM ({centiles_sql('odm')})", **PER_PATIENT_TABLES),
)
def _(s):
    return rounded(text(analysis.deciles(s.model, PER_PATIENT), "month"), "value")


TOP = {
    "top": """SELECT t.bnf_code, CAST(row_number() OVER (ORDER BY total DESC, t.bnf_code) AS INTEGER) AS position, c.name
        FROM (SELECT bnf_code, sum(value) AS total FROM mdm GROUP BY 1 ORDER BY total DESC, bnf_code LIMIT 10) t JOIN codes c ON c.code = t.bnf_code""",
    "breakdown": """SELECT coalesce(t.position, 11) AS position, t.bnf_code, coalesce(t.name, 'Other') AS medication, m.date AS month,
               CAST(sum(m.value) AS BIGINT) AS value
        FROM mdm m LEFT JOIN top t ON t.bnf_code = m.bnf_code GROUP BY 1, 2, 3, 4""",
}


@query("top_medications_other", sql("SELECT position, bnf_code, medication, CAST(month AS VARCHAR) AS month, value FROM breakdown", **WIN, **TOP))
def _(s):
    return text(analysis.top_medications_other(s.model, LISTED, MONTHS), "month")


def _stack(largest: str, other: str, order: str) -> None:
    @query(
        "stack_totals" if (largest, other) == ("top", "middle") else f"stack_totals_{largest}_{other}",
        sql(
            f"""SELECT b.medication, CAST(b.month AS VARCHAR) AS month, b.value, t.t AS medication_total, x.hi AS max_medication_total,
                       x.lo AS min_medication_total, CAST({order} AS BIGINT) AS stack_order
                FROM breakdown b JOIN (SELECT medication, CAST(sum(value) AS BIGINT) AS t FROM breakdown GROUP BY 1) t ON t.medication = b.medication
                CROSS JOIN (SELECT max(t) AS hi, min(t) AS lo FROM (SELECT CAST(sum(value) AS BIGINT) AS t FROM breakdown GROUP BY medication)) x""",
            **WIN, **TOP,
        ),
    )
    def _(s):
        shown = text(analysis.top_medications_other(s.model, LISTED, MONTHS), "month").select("medication", "month", "value")
        return analysis.stack_totals(shown, largest, other)


_stack("top", "middle", "t")
_stack("top", "top", "CASE WHEN b.medication = 'Other' THEN hi + 1 ELSE t END")
_stack("bottom", "bottom", "CASE WHEN b.medication = 'Other' THEN -hi - 1 ELSE -t END")

PANEL = {
    "win": "SELECT date FROM dates ORDER BY date DESC LIMIT 96",
    "active": "SELECT code FROM practices WHERE latest >= (SELECT min(date) FROM win)",
    "mem": "SELECT org_id, practice_code FROM members WHERE org_type = 'icb'",
    "bridge": BRIDGE,
    "by_org": "SELECT bnf_code, org_id, date, sum(items) AS n FROM rx JOIN mem USING (practice_code) GROUP BY 1, 2, 3",
    "sided": """SELECT measure, org_id, date, sum(CASE WHEN side = 'numerator' THEN n ELSE 0 END) AS num,
            sum(CASE WHEN side = 'denominator' THEN n ELSE 0 END) AS den FROM by_org JOIN bridge USING (bnf_code) GROUP BY 1, 2, 3""",
    "patients": "SELECT org_id, date, sum(total) AS p FROM lists JOIN mem USING (practice_code) WHERE practice_code IN (SELECT code FROM active) GROUP BY 1, 2",
    "panel": """SELECT g.measure, o.id AS org_id, w.date, CAST(coalesce(x.num, 0) AS BIGINT) AS num,
            CAST(CASE WHEN g.per_patient THEN coalesce(p.p, 0) ELSE coalesce(x.den, 0) END AS BIGINT) AS den, g.per_patient
        FROM (SELECT measure, bool_and(side = 'numerator') AS per_patient FROM bridge GROUP BY 1) g CROSS JOIN orgs o CROSS JOIN win w
        LEFT JOIN sided x ON x.measure = g.measure AND x.org_id = o.id AND x.date = w.date
        LEFT JOIN patients p ON p.org_id = o.id AND p.date = w.date WHERE o.org_type = 'icb'""",
    "panel_values": """SELECT measure, org_id, date, num, den,
            CASE WHEN den <> 0 THEN CAST(num AS DOUBLE) / den * CASE WHEN per_patient THEN 1000 ELSE 100 END END AS value FROM panel""",
}


@query("measure_panel", sql("SELECT measure, org_id, CAST(date AS VARCHAR) AS date, num, den, round(value, 6) AS value FROM panel_values", **PANEL))
def _(s):
    return rounded(text(analysis.measure_panel(s.model, MEASURES), "date"), "value")


@query("measure_panel_kept", sql("SELECT measure, org_id, CAST(date AS VARCHAR) AS date, num, den, round(value, 6) AS value FROM panel_values", **PANEL))
def _(s):
    """From sums that were kept by month: first of wrong facts in two months, then of these months again."""
    path = new_path(s.spark, "org_sums")
    months = [str(r["date"]) for r in s.model.dates.orderBy(F.col("date").desc()).limit(2).collect()]
    late = F.col("date").cast("string").isin(months)
    analysis.write_org_sums(replace(s.model, facts=s.model.facts.withColumn("items", F.when(late, 0).otherwise(F.col("items")))), path)
    analysis.write_org_sums(s.model, path, months=months)
    return rounded(text(analysis.measure_panel(s.model, MEASURES, sums_path=path), "date"), "value")


@query(
    "measure_deciles",
    sql(f"SELECT measure, centile, CAST(date AS VARCHAR) AS date, round(value, 6) AS value FROM ({centiles_sql('panel_values', 'measure, date')})", **PANEL),
)
def _(s):
    return rounded(text(analysis.measure_deciles(s.model, MEASURES), "date"), "value")


@query(
    "value_selector",
    sql(f"""SELECT a.code AS practice_code, CAST(w.date AS VARCHAR) AS date, CAST(coalesce(x.cost, 0) AS BIGINT) AS cost,
                   CAST(coalesce(x.quantity, 0) AS DOUBLE) AS quantity
            FROM active a CROSS JOIN win w LEFT JOIN (
                SELECT practice_code, date, sum(actual_cost) AS cost, sum(quantity) AS quantity
                FROM rx WHERE bnf_code IN ({LISTED_CODES}) GROUP BY 1, 2) x ON x.practice_code = a.code AND x.date = w.date""", **WIN),
)
def _(s):
    cost, quantity = (analysis.practice_date_matrix(s.model, LISTED, MONTHS, OUTPUT_VALUES[v]) for v in ("cost", "quantity"))
    both = cost.withColumnRenamed("value", "cost").join(quantity.withColumnRenamed("value", "quantity"), ["practice_code", "date"])
    return text(both, "date")


@query(
    "ntr_dtr_intersection",
    sql(f"""SELECT c.code, c.name, c.code IN ({codes_where(WHOLE_SQL)}) AS ntr, c.code IN ({LISTED_CODES}) AS dtr FROM codes c
            WHERE c.code IN ({codes_where(WHOLE_SQL)}) OR c.code IN ({LISTED_CODES})"""),
)
def _(s):
    return analysis.ntr_dtr_intersection(s.model, WHOLE, LISTED)


# Hierarchy reports ----------------------------------------------------------------------------------------
@query(
    "bnf_tree",
    sql(
        """SELECT n.code, n.name, n.level, max(a.code) AS parent_code, CAST(count(a.code) AS INTEGER) AS depth,
                  coalesce(string_agg(a.code, '/' ORDER BY a.code) || '/', '') || n.code AS path
           FROM nodes n LEFT JOIN nodes a ON starts_with(n.code, a.code) AND n.code <> a.code GROUP BY 1, 2, 3""",
        nodes="SELECT * FROM codes WHERE level <= 5 AND code NOT LIKE '2%'",
    ),
)
def _(s):
    return hierarchy.bnf_tree(s.codes)


CELLS = f"""SELECT substr(p.code, 1, 9) AS chemical, min(substr(g.code, 1, 9) || '_' || right(g.code, 2)) AS row_code,
           min(d.code) AS product_code, p.code, p.name,
           CASE WHEN substr(p.code, 1, 9) IN (SELECT substr(code, 1, 9) FROM pres WHERE {GENERIC}) THEN count(DISTINCT g.code) ELSE 1 END AS "rows",
           count(DISTINCT d.code) AS columns
    FROM pres p LEFT JOIN (SELECT code FROM pres WHERE {GENERIC}) g
      ON substr(p.code, 1, 9) = substr(g.code, 1, 9) AND substr(p.code, 14, 2) = substr(g.code, 12, 2)
    LEFT JOIN (SELECT code FROM codes WHERE level = 6) d ON starts_with(p.code, d.code) AND d.code <> p.code
    GROUP BY p.code, p.name"""


@query("bnf_product_cells", sql(CELLS))
def _(s):
    return hierarchy.bnf_product_cells(s.codes)


@query(
    "bnf_product_table",
    sql(
        """SELECT r.row_code, d.code AS product_code, string_agg(c.code || ' ' || c.name, '; ' ORDER BY c.code) AS presentations
           FROM (SELECT DISTINCT row_code FROM cells WHERE chemical = (SELECT chemical FROM fitting)) r
           CROSS JOIN (SELECT code FROM codes WHERE level = 6 AND starts_with(code, (SELECT chemical FROM fitting))) d
           LEFT JOIN cells c ON c.row_code = r.row_code AND c.product_code = d.code GROUP BY 1, 2""",
        cells=CELLS,
        fitting="""SELECT chemical FROM cells GROUP BY 1 HAVING min("rows") = 1 AND max("rows") = 1 AND min(columns) = 1 AND max(columns) = 1
            AND count(row_code) > 0 ORDER BY count(DISTINCT product_code) DESC, chemical LIMIT 1""",
    ),
)
def _(s):
    # The table of the chemical with the most products among those with one cell for each of their presentations.
    cells = hierarchy.bnf_product_cells(s.codes).groupBy("chemical").agg(
        F.min(F.expr("rows = 1 AND columns = 1")).alias("fits"), F.countDistinct("product_code").alias("products"), F.count("row_code").alias("listed")
    )
    chemical = cells.where("fits AND listed > 0").orderBy(F.desc("products"), "chemical").first()["chemical"]
    table = hierarchy.bnf_product_table(s.codes, chemical)
    products = [c for c in table.columns if c != "row_code"]
    shown = [F.array_join(F.transform(c, lambda x: F.concat(x["code"], F.lit(" "), x["name"])), "; ").alias(c) for c in products]
    cells = table.select("row_code", *shown).unpivot("row_code", products, "product_code", "presentations")
    return cells.withColumn("presentations", F.nullif("presentations", F.lit("")))
