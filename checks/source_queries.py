"""Scans, archives, catalogue loads and snapshots over files Spark writes from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.oracle import sql
from checks.registry import query, text
from scriptline.operators import star
from scriptline.session import new_path
from scriptline.sources import archive, catalogues, dmd, files, monthly, snapshots


@query(
    "latest_file_per_month",
    sql("SELECT CAST(day AS VARCHAR) AS date, max(name) AS name FROM m_downloads WHERE name NOT LIKE '.%' GROUP BY 1"),
)
def _(s):
    return text(files.latest_file_per_month(s.table("downloads").select("name")), "date")


@query(
    "scan_prescribing",
    sql("""SELECT bnf_code, CASE WHEN date >= DATE '1998-01-01' THEN snomed_code ELSE 0 END AS snomed_code,
           CAST(date AS VARCHAR) AS date, practice_code, quantity_value, items, quantity, net_cost, actual_cost
           FROM m_source"""),
)
def _(s):
    base = new_path(s.spark, "prescribing")
    raw = s.source.select(
        "date",
        "bnf_code",
        F.col("snomed_code").cast("string").alias("SNOMED_CODE"),
        F.col("practice_code").alias("PRACTICE_CODE"),
        F.col("quantity_value").cast("string").alias("QUANTITY"),
        F.col("items").cast("string").alias("ITEMS"),
        F.col("quantity").cast("string").alias("TOTAL_QUANTITY"),
        (F.col("net_cost") / 100).cast("string").alias("NIC"),
        (F.col("actual_cost") / 100).cast("string").alias("ACTUAL_COST"),
    )
    is_new = F.col("date") >= "1998-01-01"

    def store(rows, version):
        name = F.concat(F.lit("prescribing_"), F.col("date").cast("string"), F.lit(f"_{version}_final.parquet"))
        rows.withColumn("file", name).drop("date").hint("rebalance", "file").write.partitionBy("file").parquet(f"{base}/{version}")

    store(raw.where(is_new).withColumnRenamed("bnf_code", "BNF_CODE"), "v3")
    store(raw.where(~is_new).withColumnRenamed("bnf_code", "BNF_PRESENTATION_CODE").drop("SNOMED_CODE"), "v2")
    found = monthly.scan_prescribing(s.spark, [f"{base}/*/*"])
    return text(found, "date").withColumns({c: F.col(c).cast("double") for c in ("quantity_value", "quantity")})


@query(
    "scan_list_size",
    sql("""SELECT CAST(date AS VARCHAR) AS date, ORG_CODE AS practice_code, CAST(NUMBER_OF_PATIENTS AS BIGINT) AS total
           FROM m_list_raw WHERE ORG_TYPE = 'GP' AND SEX = 'ALL' AND AGE_GROUP_5 = 'ALL'"""),
)
def _(s):
    base = new_path(s.spark, "list_size")
    name = F.concat(F.lit("list_size_"), F.col("date").cast("string"), F.lit("_v2_final.parquet"))
    rows = s.table("list_raw").withColumn("file", name).drop("date")
    rows.hint("rebalance", "file").write.partitionBy("file").parquet(base)
    return text(monthly.scan_list_size(s.spark, [f"{base}/*"]), "date")


@query(
    "list_size_month_alignment",
    sql("""SELECT CAST(d AS VARCHAR) AS date, practice_code, total
           FROM (SELECT CAST(date + INTERVAL 9 MONTH AS DATE) AS d, practice_code, total FROM lists)
           WHERE d IN (SELECT date FROM dates)"""),
)
def _(s):
    late = s.list_sizes.withColumn("date", F.add_months("date", 9))
    return text(monthly.list_size_month_alignment(late, s.table("facts")), "date")


@query(
    "union_files_with_name",
    sql("""SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, NULL AS n_nationkey, NULL AS n_name, NULL AS n_regionkey,
                  NULL AS s_suppkey, NULL AS s_name, NULL AS s_nationkey, NULL AS s_acctbal, 'region.parquet' AS _filename FROM region
           UNION ALL SELECT NULL, NULL, CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR),
                  NULL, NULL, NULL, NULL, 'nation.csv' FROM nation
           UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR),
                  CAST(s_acctbal AS VARCHAR), 'supplier.json' FROM supplier"""),
)
def _(s):
    base = new_path(s.spark, "mixed")
    s.table("region").write.parquet(f"{base}/region.parquet")
    s.table("nation").write.csv(f"{base}/nation.csv", header=True)
    s.table("supplier").write.json(f"{base}/supplier.json")
    paths = [f"{base}/{n}" for n in ("region.parquet", "nation.csv", "supplier.json")]
    found = files.union_files_with_name(s.spark, paths).withColumn("_filename", F.element_at(F.split("_filename", "/"), -1))
    return text(found, *found.columns)


@query(
    "csv_archive",
    sql("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
                  CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part"""),
)
def _(s):
    base = new_path(s.spark, "csv")
    s.table("part").write.csv(f"{base}/part.csv", header=True, encoding="ISO-8859-1")
    archive.csv_archive(s.spark, f"{base}/part.csv", f"{base}/part.parquet", encoding="ISO-8859-1")
    return s.spark.read.parquet(f"{base}/part.parquet")


@query(
    "json_archive",
    sql("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"),
)
def _(s):
    base = new_path(s.spark, "json")
    s.table("supplier").write.json(f"{base}/supplier.json")
    archive.json_archive(s.spark, f"{base}/supplier.json", f"{base}/supplier.parquet", whole_file=False)
    return s.spark.read.parquet(f"{base}/supplier.parquet")


# Rows in one of the files that a check builds: files grow in number with the table, and none through one task.
FILE_ROWS = 500


def _one_value_a_file(rows, key: str, value, path: str) -> None:
    """One file for every ``FILE_ROWS`` rows (by a key without large gaps); ``value`` makes its text from a group of rows."""
    grouped = rows.groupBy(F.floor(F.col(key) / FILE_ROWS).alias("bucket")).agg(value.alias("value"))
    grouped.write.partitionBy("bucket").text(path)


def _as_arrays(rows, key: str, path: str) -> None:
    """Files that hold their rows as one JSON array each, spread over lines."""
    listed = F.to_json(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c != "_key")))), {"pretty": "true"})
    _one_value_a_file(rows, key, listed, path)


@query(
    "json_array_archive",
    sql("""SELECT s_suppkey, s_name || ' {"[' AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"""),
)
def _(s):
    base = new_path(s.spark, "json_array")
    _as_arrays(s.table("supplier").withColumn("s_name", F.concat("s_name", F.lit(' {"['))), "s_suppkey", f"{base}/supplier.json")
    archive.json_archive(s.spark, f"{base}/supplier.json/*", f"{base}/supplier.parquet")
    return s.spark.read.parquet(f"{base}/supplier.parquet")


@query(
    "csv_preamble_archive",
    sql("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || chr(10) || 'called "' || p_brand || '", or so' AS p_name,
                  p_brand || ' 5" wide' AS p_brand FROM part"""),
)
def _(s):
    base = new_path(s.spark, "csv_preamble")
    name = F.concat("p_name", F.lit('\ncalled ""'), "p_brand", F.lit('"", or so'))
    rows = s.table("part").withColumn("line", F.concat("p_partkey", F.lit(',"'), name, F.lit('",'), "p_brand", F.lit(' 5" wide')))
    # A preamble of two lines, one of them with a quote that nothing closes.
    head = F.array(*(F.lit(x) for x in ("A title, with a comma", 'Published "monthly', "p_partkey,p_name,p_brand")))
    _one_value_a_file(rows, "p_partkey", F.array_join(F.concat(head, F.collect_list("line")), "\n"), f"{base}/part.csv")
    archive.csv_archive(s.spark, f"{base}/part.csv/*", f"{base}/part.parquet", skip=2, multi_line=True)
    return s.spark.read.parquet(f"{base}/part.parquet")


@query(
    "xml_entities",
    sql("""SELECT CAST(vpid AS VARCHAR) AS vpid, CAST(vpidprev AS VARCHAR) AS vpidprev, CAST(vtmid AS VARCHAR) AS vtmid,
                  CASE WHEN invalid THEN '1' END AS invalid, nm FROM m_vmp"""),
)
def _(s):
    base = new_path(s.spark, "f_vmp2.xml")
    rows = s.table("vmp").select(
        F.col("vpid").alias("VPID"),
        F.col("vpidprev").alias("VPIDPREV"),
        F.col("vtmid").alias("VTMID"),
        F.when(F.col("invalid"), "1").alias("INVALID"),
        F.concat(F.lit("  "), F.col("nm"), F.lit(" ")).alias("NM"),
    )
    rows.write.format("xml").option("rootTag", "VMPS").option("rowTag", "VMP").save(base)
    found = dmd.xml_entities(s.spark, {"vmp": base})["vmp_vmp"]
    return found.select("vpid", "vpidprev", "vtmid", "invalid", "nm")


# Keys whose items one task writes.
XML_KEYS = 5_000
FILES = ("ampp", "amp", "ingredient", "vmpp", "vmp", "vtm", "lookup")
# Every field of a group holds its name, the group's number and a key; it is missing in every third row.
_GROUPS = [(i, x, g, f) for i, (x, g, fields) in enumerate((x, g, fields) for x in FILES for g, fields in dmd.table_fields(x).items()) for f in fields]
_FILLED = ", ".join(f"({i}, '{x}_{g.lower()}', '{f.lower()}')" for i, x, g, f in _GROUPS)


def _text_sums(value: F.Column) -> F.Column:
    return F.struct(F.count(value).alias("n"), F.min(value).alias("first_value"), F.max(value).alias("last_value"), F.sum(F.length(value)).cast("bigint").alias("chars"))


@query(
    "xml_all_groups",
    sql(f"""SELECT name AS table_name, field, count(*) AS n, min(value) AS first_value, max(value) AS last_value, CAST(sum(length(value)) AS BIGINT) AS chars
            FROM (SELECT g.name, g.field, g.field || ' & ' || CAST(g.i AS VARCHAR) || ' ' || CAST(p_partkey AS VARCHAR) AS value
                  FROM (VALUES {_FILLED}) g(i, name, field) CROSS JOIN part WHERE (g.i + p_partkey) % 3 <> 0) GROUP BY 1, 2"""),
)
def _(s):
    """All groups of all seven files, each with an item per part."""
    base, key = new_path(s.spark, "xml"), F.col("p_partkey")
    # A key makes some kilobytes of text, so a table that is read in one task is dealt to several.
    keys = s.table("part").select(key)
    keys = keys.repartition(max(1, keys.count() // XML_KEYS))
    counts = []
    for file_id in FILES:
        items = []
        for group, fields in dmd.table_fields(file_id).items():
            i = next(n for n, x, g, _ in _GROUPS if (x, g) == (file_id, group))
            cells = [F.when((key + i) % 3 != 0, F.concat(F.lit(f"<{f}> {f.lower()} &amp; {i} "), key, F.lit(f"\n </{f}>"))).otherwise(F.lit(f"<{f}/>" if i % 2 else "")) for f in fields]
            item = "INFO" if file_id == "lookup" else group
            wrapped = [F.lit(f"<{item}>"), *cells, F.lit(f"</{item}>")]
            items.append(F.concat(F.lit(f"<{group}>"), *wrapped, F.lit(f"</{group}>")) if file_id == "lookup" else F.concat(*wrapped))
        rows = keys.select(F.explode(F.array(*items)).alias("value"))
        rows.write.text(f"{base}/{file_id}")
        tables = dmd.xml_entities(s.spark, {file_id: f"{base}/{file_id}"})
        for name, table in tables.items():
            # All fields at once and without a key: texts as least and greatest are then found without sorting the table.
            sums = table.agg(*(_text_sums(F.col(f"`{f}`")).alias(f) for f in table.columns))
            long = sums.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("x")) for f in table.columns))).alias("f"))
            counts.append(long.select(F.lit(name).alias("table_name"), "f.field", "f.x.*").where("n > 0"))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(
    "load_dmd",
    sql("""SELECT apid, invalid, vpid, 'Maker ' || CAST(apid AS VARCHAR) AS nm, descr,
                  CASE WHEN apid % 2 = 0 THEN '2024-01-31' END AS nmdt, false AS ema FROM m_amp"""),
)
def _(s):
    raw = s.table("amp").select(
        F.col("apid").cast("string").alias("apid"),
        F.when(F.col("invalid"), "1").alias("invalid"),
        F.col("vpid").cast("string").alias("vpid"),
        F.concat(F.lit("Maker "), F.col("apid")).alias("nm"),
        F.col("descr").alias("desc"),
        F.when(F.col("apid") % 2 == 0, "2024-01-31").alias("nmdt"),
        F.lit(None).cast("string").alias("ema"),
        F.lit(None).cast("string").alias("ltd_stab"),
    )
    return text(dmd.load_dmd(raw), "nmdt")


@query("load_dmd_bnf_map", sql("SELECT p_partkey AS dmd_id, bnf_code FROM m_part_code WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0"))
def _(s):
    key = F.col("p_partkey")
    raw = s.table("part_code").select(
        F.when(key % 13 == 0, "").otherwise(key.cast("string")).alias("SNOMED Code"),
        F.when(key % 11 == 0, None).when(key % 7 == 0, "").otherwise(F.col("bnf_code")).alias("BNF Code"),
    )
    return catalogues.load_dmd_bnf_map(raw)


@query("load_bnf_codes", sql("SELECT code, level, name FROM codes"))
def _(s):
    return s.codes


@query(
    "load_ncso_concessions",
    sql("""SELECT CAST(date AS VARCHAR) AS date, CAST(vmpp AS BIGINT) AS vmpp, CAST(price AS INTEGER) AS price_pence
           FROM m_tariff_raw WHERE price IS NOT NULL AND price <> ''"""),
)
def _(s):
    base = new_path(s.spark, "concessions")
    fields = F.struct("date", F.col("vmpp").cast("bigint").alias("vmpp"), F.col("Medicine").alias("drug"), F.col("price").cast("int").alias("price_pence"))
    rows = s.table("tariff_raw").where("price IS NOT NULL AND price <> ''")
    key = F.pmod(F.xxhash64("vmpp", "date"), F.lit(1 << 40)).alias("_key")
    rows = rows.select(F.lit("concession").alias("model"), F.col("vmpp").alias("pk"), fields.alias("fields"), key)
    number = max(1, rows.count() // FILE_ROWS)
    _as_arrays(rows.withColumn("_key", F.col("_key") % number * FILE_ROWS), "_key", base)
    return text(catalogues.load_ncso_concessions(s.spark.read.option("multiLine", True).json(f"{base}/*")), "date")


@query(
    "load_drug_tariff",
    sql("""SELECT CAST(date AS VARCHAR) AS date, CAST(vmpp AS BIGINT) AS vmpp_id,
                  CASE WHEN category LIKE '%Category A' THEN 1 WHEN category LIKE '%Category C' THEN 3
                       WHEN category LIKE '%Category H' THEN 15 ELSE 11 END AS drug_tariff_category_id,
                  CAST(price AS INTEGER) + CASE WHEN date = DATE '2024-02-01' THEN 1 ELSE 0 END AS price_in_pence
           FROM m_tariff_raw WHERE price IS NOT NULL AND price <> ''"""),
)
def _(s):
    path = new_path(s.spark, "tariff")
    raw = s.table("tariff_raw").select(
        "date", "Medicine", F.col("vmpp").alias("VMPP Snomed Code"), F.col("category").alias("Drug Tariff Category"), F.col("price").alias("Basic Price")
    )
    catalogues.replace_months(catalogues.load_drug_tariff(raw), path)
    changed = raw.where(F.col("date") == "2024-02-01").withColumn("Basic Price", (F.expr("try_cast(`Basic Price` AS INT)") + 1).cast("string"))
    catalogues.replace_months(catalogues.load_drug_tariff(changed), path)
    return text(s.spark.read.parquet(path), "date")


@query("load_bnf_code_changes", sql("SELECT old_code, new_code FROM m_bnf_changes"))
def _(s):
    path = new_path(s.spark, "changes.csv")
    s.table("bnf_changes").write.csv(path, header=True)
    return catalogues.load_bnf_code_changes(s.spark, path)


NORM = """SELECT p.id AS presentation_id, d.id AS date_id, r.id AS practice_id, quantity_value, items, quantity, net_cost, actual_cost
          FROM m_source s JOIN presentation p ON p.bnf_code = s.bnf_code AND p.snomed_code = s.snomed_code
          JOIN date_ids d ON d.date = s.date JOIN practice r ON r.code = s.practice_code"""
IDS = {
    "date_ids": "SELECT CAST(row_number() OVER (ORDER BY date DESC) - 1 AS INTEGER) AS id, date FROM dates",
    "practice": "SELECT row_number() OVER (ORDER BY latest DESC, code) - 1 AS id, code, latest FROM practices",
    "presentation": "SELECT row_number() OVER (ORDER BY bnf_code, snomed_code) AS id, bnf_code, snomed_code, last FROM presentations",
}


def norm(s):
    return star.prescribing_norm(s.source, star.date_dim(s.source), star.practice_dim(s.source), star.presentation_dim(s.source))


@query("write_prescribing_clustered", sql(NORM, **IDS))
def _(s):
    path = new_path(s.spark, "prescribing_norm")
    snapshots.write_clustered(norm(s), path)
    return s.spark.read.parquet(path)


@query(
    "ingest_manifest",
    sql("""SELECT name, 'new' AS status FROM (SELECT DISTINCT name FROM m_downloads WHERE event_id % 5 <> 0)
           WHERE name NOT IN (SELECT name FROM m_downloads WHERE event_id % 7 <> 0)
           UNION ALL
           SELECT name, 'gone' FROM (SELECT DISTINCT name FROM m_downloads WHERE event_id % 7 <> 0)
           WHERE name NOT IN (SELECT name FROM m_downloads WHERE event_id % 5 <> 0)"""),
)
def _(s):
    named = s.table("downloads")
    return snapshots.ingest_manifest(named.where("event_id % 5 <> 0").select("name"), named.where("event_id % 7 <> 0").select("name"))


@query(
    "snapshot_high_water_mark",
    sql("""SELECT f.dataset, f.name, coalesce(m.mark, '') AS mark, f.name > coalesce(m.mark, '') AS ingest
           FROM (SELECT dataset, max(name) AS name FROM m_downloads GROUP BY 1) f
           LEFT JOIN (SELECT dataset, max(name) AS mark FROM m_downloads WHERE dataset < 'purchase' OR event_id % 2 = 0 AND day < DATE '2024-01-05'
                      GROUP BY 1) m ON m.dataset = f.dataset"""),
)
def _(s):
    named = s.table("downloads")
    marks = named.where("dataset < 'purchase' OR event_id % 2 = 0 AND day < DATE '2024-01-05'").groupBy("dataset").agg(F.max("name").alias("mark"))
    return snapshots.snapshot_high_water_mark(named, marks)
