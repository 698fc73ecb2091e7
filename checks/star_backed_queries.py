"""Analyses on the written star, the path users and the bench take, with a window shorter than the months."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.filter_queries import MEASURES
from checks.matrix_queries import LISTED, MONTHS, PANEL, PER_ITEM, TOP, WIN
from checks.oracle import centiles_sql, codes_where, ratio_tables, sql
from checks.registry import query, rounded, text
from checks.sample import star_model
from scriptline.operators import chains
from scriptline.operators.measures import Measure
from scriptline.plans import analysis, ingest
from scriptline.session import new_path
from scriptline.streaming import nightly

RATIO = ratio_tables(
    codes_where("(starts_with(code, '01') OR starts_with(code, '02')) AND substr(code, 10, 2) = 'AA'"),
    codes_where("starts_with(code, '01') OR starts_with(code, '02')"), "icb", MONTHS,
)
SHORT_PANEL = PANEL | {"win": f"SELECT date FROM dates ORDER BY date DESC LIMIT {MONTHS}"}


@query("star_practice_date_matrix", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value FROM pdm", **WIN))
def _(s):
    return text(analysis.practice_date_matrix(star_model(s), LISTED, MONTHS), "date")


@query("star_practice_list_size_matrix", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, value FROM lists_pdm", **WIN))
def _(s):
    return text(analysis.practice_date_matrix(star_model(s), None, MONTHS), "date")


@query("star_medication_date_matrix", sql("SELECT bnf_code, CAST(date AS VARCHAR) AS date, value FROM mdm", **WIN))
def _(s):
    return text(analysis.medication_date_matrix(star_model(s), LISTED, MONTHS), "date")


@query("star_org_date_ratio", sql("SELECT org_id, CAST(date AS VARCHAR) AS date, round(value, 6) AS value FROM odm", **RATIO))
def _(s):
    return rounded(text(analysis.org_date_ratio(star_model(s), PER_ITEM, MONTHS), "date"), "value")


@query("star_deciles", sql(f"SELECT centile, CAST(date AS VARCHAR) AS month, round(value, 6) AS value FROM ({centiles_sql('odm')})", **RATIO))
def _(s):
    return rounded(text(analysis.deciles(star_model(s), PER_ITEM, MONTHS), "month"), "value")


@query("star_top_medications_other", sql("SELECT position, bnf_code, medication, CAST(month AS VARCHAR) AS month, value FROM breakdown", **WIN, **TOP))
def _(s):
    return text(analysis.top_medications_other(star_model(s), LISTED, MONTHS), "month")


@query(
    "star_measure_panel",
    sql("SELECT measure, org_id, CAST(date AS VARCHAR) AS date, num, den, round(value, 6) AS value FROM panel_values", **SHORT_PANEL),
)
def _(s):
    return rounded(text(analysis.measure_panel(star_model(s), MEASURES, date_count=MONTHS), "date"), "value")


# A panel of the size that is in use: a hundred measures from their definitions, every tenth per patient.
def _wide(i: int) -> tuple[str, dict, str, str | None]:
    chapter = f"{i % 20 + 1:02d}"
    section = f"{chapter}{i // 20 + 1:02d}"
    numerator = {"bnf_codes": [section], "product_type": "generic" if i % 3 else "all"}
    generic = " AND substr(code, 10, 2) = 'AA'" if i % 3 else ""
    query_ = {"numerator": numerator} if i % 10 == 9 else {"numerator": numerator, "denominator": {"bnf_codes": [chapter]}}
    kind = "prescribing_vs_list_size" if i % 10 == 9 else "prescribing_vs_prescribing"
    values = {"metadata": {"title": f"Measure {i}", "tags": ["wide"]}, "options": {"type": kind, "output_value": "items"}, "queries": [query_]}
    return f"m{i:02d}", values, f"starts_with(code, '{section}'){generic}", None if i % 10 == 9 else f"starts_with(code, '{chapter}')"


_WIDE = [_wide(i) for i in range(100)]
WIDE_MEASURES = [Measure.from_dict(name, values) for name, values, _, _ in _WIDE]
_WIDE_SIDES = [(n, side, c) for n, _, num, den in _WIDE for side, c in (("numerator", num), ("denominator", den)) if c]
WIDE = SHORT_PANEL | {
    "bridge": " UNION ALL ".join(f"SELECT '{n}' AS measure, '{side}' AS side, code AS bnf_code FROM pres WHERE {c}" for n, side, c in _WIDE_SIDES),
    "panel": PANEL["panel"].replace(
        "(SELECT measure, bool_and(side = 'numerator') AS per_patient FROM bridge GROUP BY 1)",
        "(VALUES " + ", ".join(f"('{n}', {str(den is None).lower()})" for n, _, _, den in _WIDE) + ")",
    ).replace(") g CROSS", ") g(measure, per_patient) CROSS"),
}


@query(
    "measure_panel_wide",
    sql("SELECT measure, org_id, CAST(date AS VARCHAR) AS date, num, den, round(value, 6) AS value FROM panel_values", **WIDE),
)
def _(s):
    return rounded(text(analysis.measure_panel(star_model(s), WIDE_MEASURES, date_count=MONTHS), "date"), "value")


# From files -----------------------------------------------------------------------------------------------
def _store(rows, base: str, prefix: str, suffix: str) -> None:
    """Monthly files named prefix_date_suffix, as Spark writes them."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("date").cast("string"), F.lit(suffix))
    rows.withColumn("file", name).drop("date").hint("rebalance", "file").write.partitionBy("file").parquet(base)


def _prescribing_files(s, base: str) -> None:
    """Files of all months below a folder that carries a date, with earlier issues and hidden files."""
    rx = s.source.select(
        "date",
        F.col("bnf_code").alias("BNF_CODE"),
        F.col("snomed_code").cast("string").alias("SNOMED_CODE"),
        F.col("practice_code").alias("PRACTICE_CODE"),
        F.col("quantity_value").cast("string").alias("QUANTITY"),
        F.col("items").cast("string").alias("ITEMS"),
        F.col("quantity").cast("string").alias("TOTAL_QUANTITY"),
        (F.col("net_cost") / 100).cast("string").alias("NIC"),
        (F.col("actual_cost") / 100).cast("string").alias("ACTUAL_COST"),
    )
    wrong = rx.where(F.month("date") == 3).withColumn("ITEMS", F.lit("7"))
    _store(rx, f"{base}/rx/new", "prescribing", "_v3_final.parquet")
    _store(wrong, f"{base}/rx/old", "prescribing", "_v2_first.parquet")
    _store(wrong, f"{base}/rx/hidden", ".prescribing", "_v9_partial.parquet")


def _list_size_files(s, base: str) -> None:
    """Patient lists of all months and some later ones, with files of another version."""
    lists = s.table("list_raw")
    _store(lists, f"{base}/lists/new", "list_size", "_v2_final.parquet")
    _store(lists.withColumn("NUMBER_OF_PATIENTS", F.lit("1")), f"{base}/lists/other", "list_size", "_v3_other.parquet")
    later = lists.withColumn("date", F.add_months("date", 120)).where(F.month("date") == 1)
    _store(later, f"{base}/lists/later", "list_size", "_v2_final.parquet")


@query(
    "ingest_from_files",
    sql("""SELECT 'prescribing' AS kind, CAST(date AS VARCHAR) AS date, practice_code, CAST(sum(items) AS BIGINT) AS items, CAST(sum(actual_cost) AS BIGINT) AS cost
           FROM m_source WHERE practice_code <> '-' GROUP BY 2, 3
           UNION ALL
           SELECT 'patients', CAST(date AS VARCHAR), practice_code, CAST(sum(total) AS BIGINT), NULL FROM lists
           WHERE date IN (SELECT date FROM dates) AND practice_code IN (SELECT code FROM practices) GROUP BY 2, 3"""),
)
def _(s):
    base = new_path(s.spark, "backup_2024-06-01_full")
    _prescribing_files(s, base)
    _list_size_files(s, base)
    root = new_path(s.spark, "star")
    args = (f"{base}/rx/*/*", f"{base}/lists/*/*", s.table("bnf_changes"), chains.vmp_code_change_chain(s.table("vmp")))
    if not ingest.ingest_folders(s.spark, root, "first", *args) or ingest.ingest_folders(s.spark, root, "second", *args):
        raise ValueError("the same files are ingested once")
    table = lambda name: s.spark.read.parquet(f"{root}/versions/first/{name}")
    dates = table("date").select(F.col("id").alias("date_id"), F.col("date").cast("string").alias("date"))
    practices = table("practice").select(F.col("id").alias("practice_id"), F.col("code").alias("practice_code"))

    def summed(name: str, kind: str, items: str, cost: F.Column):
        rows = table(name).join(dates, "date_id").join(practices, "practice_id")
        sums = rows.groupBy("date", "practice_code").agg(F.sum(items).cast("bigint").alias("items"), cost.cast("bigint").alias("cost"))
        return sums.select(F.lit(kind).alias("kind"), "date", "practice_code", "items", "cost")

    rx = summed("prescribing_norm", "prescribing", "items", F.sum("actual_cost"))
    return rx.unionByName(summed("list_size_norm", "patients", "total", F.max(F.lit(None).cast("bigint"))))


@query(
    "nightly_ingest",
    sql("""SELECT CAST(date AS VARCHAR) AS date, practice_code, CAST(sum(items) AS BIGINT) AS items, count(*) AS n
           FROM m_source GROUP BY 1, 2"""),
)
def _(s):
    base = new_path(s.spark, "night")
    _prescribing_files(s, base)
    table = new_path(s.spark, "monthly")
    # The first night brings the final issues, the second the superseded and hidden ones.
    nightly.ingest_new_files(s.spark, f"{base}/rx/new/*", table, f"{base}/state-1")
    nightly.ingest_new_files(s.spark, f"{base}/rx/*/*", table, f"{base}/state-2")
    rows = nightly.read_months(s.spark, table).groupBy("date", "practice_code")
    return text(rows.agg(F.sum("items").cast("bigint").alias("items"), F.count(F.lit(1)).alias("n")), "date")
