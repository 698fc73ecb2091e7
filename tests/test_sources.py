import csv
import datetime
import html
import json
import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from conftest import rows
from scriptline import session
from scriptline.functions import filenames
from scriptline.operators import star
from scriptline.sources import archive, blocks, catalogues, dmd, files, monthly, snapshots

DAY = datetime.date(2025, 1, 1)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_latest_file_per_month(spark):
    found = files.latest_file_per_month(names(spark, "a_2025-01-01_v1.csv", "a_2025-01-01_v2.csv", ".a_2025-01-01_v9", "a_2025-02-01_x"))
    assert rows(found) == [(DAY, "a_2025-01-01_v2.csv"), (datetime.date(2025, 2, 1), "a_2025-02-01_x")]
    with pytest.raises(Exception, match="Expecting a filename"):
        files.latest_file_per_month(names(spark, "a_20250101.csv")).collect()


def test_file_names(spark, tmp_path):
    for name in ("prescribing_2025-01-01_v3.parquet", "prescribing_2025-02-01_v3.parquet"):
        (tmp_path / name).write_bytes(b"not read")
    found = files.file_names(spark, str(tmp_path / "*"))
    assert {r.name for r in files.latest_file_per_month(found).collect()} == {p.name for p in tmp_path.iterdir()}


def test_many_files_plan_a_scan_for_each_layout(spark, tmp_path):
    expected = []
    for i in range(60):
        name = str(tmp_path / f"a {i}+.csv")
        with open(name, "w") as f:
            f.write(("x,y\n1,2\n", "x,z\n1,3\n", "y,x\n2,1\n")[i % 3])
        expected.append(("1", None if i % 3 == 1 else "2", "3" if i % 3 == 1 else None, name))
    found = files.union_files_with_name(spark, [e[-1] for e in expected])
    assert rows(found.select("x", "y", "z", "_filename")) == sorted(expected, key=repr)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
    for i in range(4):
        spark.createDataFrame([(i,)], "x int").write.parquet(str(tmp_path / f"p{i}.parquet"))
    paths = [str(tmp_path / f"p{i}.parquet") for i in range(4)]
    found = files.union_files_with_name(spark, paths)
    assert rows(found) == [(i, p) for i, p in enumerate(paths)] and found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    spark.createDataFrame([("q",)], "x string").write.parquet(str(tmp_path / "q.parquet"))
    found = files.union_files_with_name(spark, [*paths, str(tmp_path / "q.parquet")])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2 and {r.x for r in found.collect()} == {"0", "1", "2", "3", "q"}
    with pytest.raises(ValueError, match="Unknown kind"):
        files.union_files_with_name(spark, ["a.xlsx"])


def test_csv_with_preamble_and_encoding(spark, tmp_path):
    lines = ["Drug Tariff", "", "Medicine,VMPP Snomed Code,Drug Tariff Category,Basic Price", 'Caf\xe9 "x",001,A,10', '"Two, three",2,C,', "", "Last,3,,5"]
    source = tmp_path / "t.csv"
    source.write_bytes("\n".join(lines).encode("latin-1"))
    archive.csv_archive(spark, str(source), str(tmp_path / "t.parquet"), encoding="ISO-8859-1", skip=2)
    found = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert found.columns == ["Medicine", "VMPP Snomed Code", "Drug Tariff Category", "Basic Price"]
    assert {t for _, t in found.dtypes} == {"string"}
    assert rows(found) == sorted([('Caf\xe9 "x"', "001", "A", "10"), ("Two, three", "2", "C", None), ("Last", "3", None, "5")], key=repr)


def test_preamble_of_a_file_in_many_splits(spark, tmp_path):
    source = tmp_path / "big.csv"
    source.write_text("skip me\nskip me too\nid,text\n" + "".join(f"{i},{'x' * 50}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert blocks.pieces(spark, str(source), "\n").select("block").distinct().count() > 4
        lines = archive.read_csv_strings(spark, str(source), skip=2)
        assert lines.count() == 20000 and lines.select(F.sum(F.col("id").cast("bigint"))).first()[0] == 19999 * 10000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_array(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"id": "A", "n": 1, "roles": ["x"]}, {"id": "B", "n": None, "roles": []}]))
    archive.json_archive(spark, str(tmp_path / "o.json"), str(tmp_path / "o.parquet"))
    found = spark.read.parquet(str(tmp_path / "o.parquet"))
    assert dict(found.dtypes) == {"id": "string", "n": "bigint", "roles": "array<string>"} and found.count() == 2


def test_monthly_layouts(spark, tmp_path):
    old = spark.createDataFrame([("0101", "P1", "1", "2", "2", "1.149999", "1.15")], "BNF_PRESENTATION_CODE string, PRACTICE_CODE string, QUANTITY string, ITEMS string, TOTAL_QUANTITY string, NIC string, ACTUAL_COST string")
    new = old.withColumnRenamed("BNF_PRESENTATION_CODE", "BNF_CODE").withColumn("SNOMED_CODE", F.lit("42"))
    old.write.parquet(str(tmp_path / "prescribing_2024-12-01_v2_a.parquet"))
    new.write.parquet(str(tmp_path / "prescribing_2025-01-01_v3_a.parquet"))
    found = monthly.scan_prescribing(spark, [str(p) for p in tmp_path.iterdir()])
    assert rows(found.select("bnf_code", "snomed_code", "date", "items", "net_cost", "actual_cost")) == [
        ("0101", 0, datetime.date(2024, 12, 1), 2, 115, 115),
        ("0101", 42, DAY, 2, 115, 115),
    ]


def test_bad_number_fails(spark, tmp_path):
    df = spark.createDataFrame([("0101", "P1", "many")], "BNF_CODE string, PRACTICE_CODE string, ITEMS string")
    df.write.parquet(str(tmp_path / "prescribing_2025-01-01_v3.parquet"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        monthly.scan_prescribing(spark, [str(tmp_path / "prescribing_2025-01-01_v3.parquet")]).collect()


def test_list_size_rows(spark, tmp_path):
    schema = "ORG_CODE string, NUMBER_OF_PATIENTS string, ORG_TYPE string, SEX string, AGE_GROUP_5 string"
    data = [("P1", "10", "GP", "ALL", "ALL"), ("P1", "4", "GP", "MALE", "ALL"), ("P1", "1", "GP", "ALL", "0_4"), ("C1", "99", "CCG", "ALL", "ALL")]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "list_size_2025-01-01_v2_x.parquet"))
    assert rows(monthly.scan_list_size(spark, [str(tmp_path / "*")])) == [(DAY, "P1", 10)]


VMP_XML = """<?xml version="1.0" encoding="utf-8"?>
<VIRTUAL_MED_PRODUCTS><!-- generated -->
<VMPS><VMP><VPID>11</VPID><VTMID>7</VTMID><NM> Coal tar 10% </NM><BASISCD>0007</BASISCD><GLU_F>0001</GLU_F><UDFS>1.5</UDFS><VPIDDT>2020-02-03</VPIDDT></VMP>
<VMP><VPID>12</VPID><VPIDPREV>11</VPIDPREV><INVALID>1</INVALID><NM>Other</NM></VMP></VMPS>
<VIRTUAL_PRODUCT_INGREDIENT><VPI><VPID>11</VPID><ISID>5</ISID></VPI></VIRTUAL_PRODUCT_INGREDIENT>
</VIRTUAL_MED_PRODUCTS>"""
LOOKUP_XML = """<?xml version="1.0" encoding="utf-8"?>
<LOOKUP><FORM><INFO><CD>1</CD><CDDT>2004-01-01</CDDT><DESC>Tablet </DESC></INFO></FORM>
<ONT_FORM_ROUTE><INFO><CD>2</CD><DESC>tablet.oral</DESC></INFO><INFO><CD>3</CD><DESC>solution.oral</DESC></INFO></ONT_FORM_ROUTE></LOOKUP>"""


def test_dictionary_xml(spark, tmp_path):
    (tmp_path / "f_vmp2_1.xml").write_text(VMP_XML)
    (tmp_path / "f_lookup2_1.xml").write_text(LOOKUP_XML)
    tables = dmd.xml_entities(spark, {"vmp": str(tmp_path / "f_vmp2_1.xml"), "lookup": str(tmp_path / "f_lookup2_1.xml")})
    assert len(dmd.LOOKUP_GROUPS) + sum(len(t) for t in dmd.ENTITIES.values()) == 47
    vmp = dmd.load_dmd(tables["vmp_vmp"])
    assert rows(vmp.select("vpid", "vpidprev", "vtmid", "nm", "basiscd", "glu_f", "invalid", F.col("udfs").cast("double"), "vpiddt")) == [
        (11, None, 7, "Coal tar 10%", 7, True, False, 1.5, datetime.date(2020, 2, 3)),
        (12, 11, None, "Other", None, False, True, None, None),
    ]
    assert rows(dmd.load_dmd(tables["vmp_vpi"]).select("vpid", "isid")) == [(11, 5)]
    assert rows(dmd.load_dmd(tables["lookup_ont_form_route"])) == [(2, "tablet.oral"), (3, "solution.oral")]
    assert rows(tables["lookup_form"]) == [("1", "2004-01-01", None, "Tablet")]
    assert tables["vmp_droute"].isEmpty() and tables["lookup_supplier"].isEmpty()


def test_reimbursement_info(spark):
    schema = "appid string, bb string, ltd_stab string, dnd string"
    assert dmd.load_dmd(spark.createDataFrame([("1", None, None, "0001")], schema)).first().asDict() == {"appid": 1, "bb": False, "dndcd": 1}
    with pytest.raises(Exception, match="Unexpected value in ltd_stab"):
        dmd.load_dmd(spark.createDataFrame([("1", None, "x", None)], schema)).collect()


def wide(spark, data):
    columns = ", ".join(f"BNF_{level}_CODE string, BNF_{level} string" for level in catalogues.HIERARCHY)
    return spark.createDataFrame([tuple(x for pair in row for x in pair) for row in data], columns)


def test_bnf_codes(spark):
    # A bandage without chemical and product: these levels repeat the one above.
    row = [("20", "Dressings"), ("2001", "Bandages"), ("200101", "Crepe"), ("2001010", "Crepe"), ("2001010", "Crepe"), ("2001010", "Crepe"), ("20010100001", "Crepe 5cm")]
    found = catalogues.load_bnf_codes(wide(spark, [row, row, [(None, None)] * 7]))
    assert rows(found) == sorted(
        [("20", 1, "Dressings"), ("2001", 2, "Bandages"), ("200101", 3, "Crepe"), ("2001010", 4, "Crepe"), ("20010100001", 7, "Crepe 5cm")], key=repr
    )
    with pytest.raises(Exception, match="More than one name"):
        catalogues.load_bnf_codes(wide(spark, [row, [("20", "Other"), *row[1:]]])).collect()


def test_drug_tariff(spark, tmp_path):
    schema = f"date date, {catalogues.TARIFF_COLUMNS}"
    month = [(DAY, "A", "1", "Part VIIIA Category A", "100"), (DAY, "B", "2", "Part VIIIA Category M", None), (DAY, "C", "3", "Part VIIIA Category H", "")]
    prices = catalogues.load_drug_tariff(spark.createDataFrame(month, schema))
    assert rows(prices) == [(DAY, 1, 1, 100)]
    path = str(tmp_path / "tariff")
    later = datetime.date(2025, 2, 1)
    catalogues.replace_months(prices, path)
    catalogues.replace_months(catalogues.load_drug_tariff(spark.createDataFrame([(later, "A", "1", "Category C", "7")], schema)), path)
    catalogues.replace_months(catalogues.load_drug_tariff(spark.createDataFrame([(DAY, "A", "1", "Category A", "90")], schema)), path)
    assert rows(spark.read.parquet(path).select("date", "price_in_pence")) == [(DAY, 90), (later, 7)]
    with pytest.raises(Exception, match="Unknown category"):
        catalogues.load_drug_tariff(spark.createDataFrame([(DAY, "A", "1", "Category Z", "1")], schema)).collect()


def test_concessions(spark, tmp_path):
    record = {"model": "m", "pk": 1, "fields": {"date": "2025-01-01", "vmpp": 55, "drug": "d", "pack_size": "28", "price_pence": 120}}
    (tmp_path / "c.json").write_text(json.dumps([record]))
    raw = spark.read.option("multiLine", True).json(str(tmp_path / "c.json"))
    assert rows(catalogues.load_ncso_concessions(raw)) == [(DAY, 55, 120)]


def test_clustered_fact_is_in_order(spark, tmp_path):
    # One presentation holds half of the rows and still spans several files.
    norm = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 20).alias("presentation_id"), (F.col("id") % 12).alias("date_id"), (F.col("id") % 97).alias("practice_id")
    )
    path = str(tmp_path / "fact")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows end in one file
    try:
        snapshots.write_clustered(norm, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.struct(*snapshots.CLUSTER_KEYS)).alias("low"), F.max(F.struct(*snapshots.CLUSTER_KEYS)).alias("high")
    ).orderBy("low").collect()
    assert len(spans) > 4 and all(tuple(a.high) <= tuple(b.low) for a, b in zip(spans, spans[1:]))
    assert sum(s.low.presentation_id == 7 or s.high.presentation_id == 7 for s in spans) > 2


def test_high_water_mark(spark):
    found = spark.createDataFrame([("ods", "ods_1"), ("ods", "ods_2"), ("dmd", "dmd_1")], "dataset string, name string")
    marks = spark.createDataFrame([("ods", "ods_2")], "dataset string, mark string")
    assert rows(snapshots.snapshot_high_water_mark(found, marks)) == [("dmd", "dmd_1", "", True), ("ods", "ods_2", "ods_2", False)]
    dated = spark.createDataFrame([(DAY,), (datetime.date(2025, 2, 1),)], "date date")
    assert rows(snapshots.files_after_mark(dated, "2025-01-01")) == [(datetime.date(2025, 2, 1),)]


def ranged_fact(spark, path, rows, number):
    """A fact whose presentation 7 holds half of the rows, written in ranges; returns the span of every file."""
    norm = spark.range(rows).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 20).alias("presentation_id"), (F.col("id") % 12).alias("date_id"), (F.col("id") % 97).alias("practice_id")
    )
    steps = snapshots.cell_ranges(norm.groupBy("presentation_id", "date_id").agg(F.count("*").alias("n")), number)
    snapshots.write_in_ranges(norm.join(F.broadcast(steps), "presentation_id"), path, number)
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.struct("presentation_id", "date_id")).alias("low"), F.max(F.struct("presentation_id", "date_id")).alias("high"), F.count("*").alias("n")
    ).orderBy("low", "high").collect()


def test_ranges_from_counts_are_in_order(spark, tmp_path):
    spans = ranged_fact(spark, str(tmp_path / "fact"), 4000, 16)
    assert len(spans) > 8 and sum(s.n for s in spans) == 4000 and max(s.n for s in spans) < 800
    assert all(tuple(a.high) <= tuple(b.low) for a, b in zip(spans, spans[1:]))
    assert sum(s.low.presentation_id == 7 or s.high.presentation_id == 7 for s in spans) > 4


def test_files_grow_in_number_with_the_rows(spark, tmp_path):
    made = []
    for rows_ in (6000, 24000):
        number = snapshots.range_number(rows_, 1, range_bytes=100 * snapshots.ROW_BYTES * 10)
        spans = ranged_fact(spark, str(tmp_path / f"fact{rows_}"), rows_, number)
        made.append((number, len(spans), max(s.n for s in spans)))
    assert made[1][0] == 4 * made[0][0] and 3 <= made[1][1] / made[0][1] <= 5
    assert max(m for *_, m in made) < 3000  # hot months are dealt


def test_number_of_ranges():
    assert snapshots.range_number(0, 8) == 1 and snapshots.range_number(10**6, 8) == 8
    assert snapshots.range_number(10**9, 8) == 239 and snapshots.range_number(10**13, 8) == snapshots.MOST_RANGES


def test_star_shuffles_the_fact_once(spark):
    """Dimensions of a known size are broadcast, the range comes with the presentation: one exchange, by range."""
    source = spark.range(1000).selectExpr("'0101' AS bnf_code", "id % 5 AS snomed_code", "DATE'2025-01-01' AS date", "'P1' AS practice_code", *(f"id AS {c}" for c in star.MEASURED))
    dates = spark.createDataFrame([(0, DAY)], "id int, date date")
    practices = spark.createDataFrame([(0, "P1")], "id int, code string")
    steps = spark.range(5).selectExpr("id", "'0101' AS bnf_code", "id AS snomed_code", "array(named_struct('date_id', 0, 'range', 0, 'parts', 2)) AS steps")
    norm = star.prescribing_norm(source, dates, practices, steps, ("steps",), (1, 1, 5))
    plan = norm.repartitionById(4, F.element_at("steps", 1)["range"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange") == 1 + physical.count("BroadcastExchange") and "SortMergeJoin" not in physical


def test_dates_come_from_the_files_own_name(spark):
    paths = ["/d/backup_2024-06-01_full/prescribing_2023-01-01_v3.parquet", "/d/x_2024-06-01_y/file=list_2023-02-01_v2/part-0.parquet", "/d/list_2023-03-01_v2.parquet/part-1.snappy.parquet"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [str(r[0]) for r in table.select(filenames.path_date(F.col("path"))).collect()] == ["2023-01-01", "2023-02-01", "2023-03-01"]
    nameless = spark.createDataFrame([("/d/backup_2024-06-01_full/prescribing.parquet",)], "path string")
    with pytest.raises(Exception, match="Expecting a filename containing an ISO date"):
        nameless.select(filenames.path_date(F.col("path"))).collect()


def test_two_names_fail_whatever_is_read(spark):
    wide = ", ".join(f"'0{i}' AS BNF_{level}_CODE, 'n' AS BNF_{level}" for i, level in enumerate(catalogues.HIERARCHY))
    codes = catalogues.load_bnf_codes(spark.sql(f"SELECT {wide} UNION ALL SELECT {wide.replace(chr(39) + 'n' + chr(39), chr(39) + 'm' + chr(39), 1)}"))
    with pytest.raises(Exception, match="More than one name for code 00"):
        codes.select("code").collect()


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of two kilobytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_preambles_of_several_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"title\nx,y\n1,{name}\n")
    assert rows(archive.read_csv_strings(spark, str(tmp_path), skip=1)) == [("1", "a"), ("1", "b")]
    (tmp_path / "b.csv").write_text("title\ny,x\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        archive.read_csv_strings(spark, str(tmp_path), skip=1)
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    assert rows(archive.read_csv_strings(spark, str(tmp_path / "a.csv"), multi_line=True)) == [("1", "two\nlines")]
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        archive.read_csv_strings(spark, str(tmp_path / "a.csv"), multi_line=True)
    (tmp_path / "a.csv").write_text("x,y\n1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        archive.read_csv_strings(spark, str(tmp_path / "a.csv"), multi_line=True).collect()


@pytest.mark.parametrize("seed", range(3))
def test_quoted_line_breaks_in_blocks(spark, tmp_path, small_blocks, seed):
    """Several files of several blocks behind preambles, against the csv module."""
    rng, parts = random.Random(seed), ['"', ",", "\n", "\r\n", "a", "é", " ", "long words " * 9, '""', "\\"]
    expected = []
    for name in "abc":
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as f:
            f.write('one "odd quote\nand another line\n')
            out = csv.writer(f, lineterminator="\r\n" if seed else "\n")
            out.writerow(["id", "te\nxt", "rest"])
            for i in range(150):
                row = [f"{name}{i}", "".join(rng.choice(parts) for _ in range(rng.randint(1, 9))), 'in"ches']
                out.writerow(row)
                expected.append(tuple(row))
    found = archive.read_csv_strings(spark, str(tmp_path), skip=2, multi_line=True)
    assert found.columns == ["id", "te\nxt", "rest"]
    assert blocks.pieces(spark, str(tmp_path), "\n").select("file", "block").distinct().count() > 12
    got = {r[0]: tuple(r) for r in found.collect()}
    assert len(got) == len(expected)
    for row in expected:
        assert got[row[0]][2] == row[2]
        assert norm_space(got[row[0]][1]) == norm_space(row[1])


def norm_space(text):
    """White space around an unquoted value, and the form of a line break, are the parser's."""
    return (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()


def nested(rng, depth=0):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "x", "é", "\n", " "]) for _ in range(rng.randint(0, 12)))
    inner = [nested(rng, depth + 1) for _ in range(rng.randint(0, 2))] if depth < 3 else []
    return {"name": text, "n": rng.randint(0, 9), "inner": inner, "deep": {"text": text[::-1]}}


@pytest.mark.parametrize(("seed", "indent"), [(1, None), (2, 2), (3, "\t")])
def test_array_files_in_blocks(spark, tmp_path, small_blocks, seed, indent):
    rng = random.Random(seed)
    objects = [nested(rng) | {"id": i} for i in range(200)]
    (tmp_path / "o.json").write_text(json.dumps(objects, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[ ]")
    assert blocks.pieces(spark, str(tmp_path / "o.json"), "}").select("block").distinct().count() > 10
    archive.json_archive(spark, str(tmp_path / "*.json"), str(tmp_path / "o.parquet"))
    whole = spark.read.option("multiLine", True).option("samplingRatio", 1.0).json(str(tmp_path / "o.json"))
    found = spark.read.parquet(str(tmp_path / "o.parquet"))
    assert found.schema == whole.schema and rows(found) == rows(whole)


def test_arrays_of_something_else(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": "}"}}\n{"a": {"b": "{"}}\n')  # one after another
    archive.json_archive(spark, str(tmp_path / "a.json"), str(tmp_path / "a.parquet"))
    assert rows(spark.read.parquet(str(tmp_path / "a.parquet")).select("a.b")) == [("{",), ("}",)]
    for text in ('[1, {"a": 1}]', "[[1], [2]]", '[{"a": 1}, 2]'):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(Exception, match="not an object of a JSON array"):
            archive.json_elements(spark, str(tmp_path / "b.json"))


def test_dictionary_xml_in_blocks(spark, tmp_path, small_blocks):
    """Items, fields and groups that begin in one block and end in another, entities, empty and repeated fields."""
    names = [f"Name {i} &lt;{'long ' * (i % 40)}&#233;&amp;&gt;" for i in range(300)]
    items = "".join(f"<VMP><VPID>{i}</VPID>\n<NM> {n}\n</NM><ABBREVNM/><VTMID></VTMID></VMP>" for i, n in enumerate(names))
    forms = "".join(f"<ONT><VPID>{i}</VPID><FORMCD>1</FORMCD><FORMCD>{i % 7}</FORMCD></ONT>" for i in range(300))
    (tmp_path / "vmp.xml").write_text(f'<?xml version="1.0"?><A x="1"><!-- made --><VMPS>{items}</VMPS><FORMS>{forms}</FORMS></A>')
    lookups = "".join(f"<{g}>{''.join(f'<INFO><CD>{i}</CD><DESC>{g} {i}</DESC></INFO>' for i in range(40))}</{g}>" for g in dmd.LOOKUP_GROUPS)
    (tmp_path / "lookup.xml").write_text(f"<LOOKUP>{lookups}</LOOKUP>")
    tables = dmd.xml_entities(spark, {"vmp": str(tmp_path / "vmp.xml"), "lookup": str(tmp_path / "lookup.xml")})
    found = {int(r.vpid): (r.nm, r.abbrevnm, r.vtmid) for r in tables["vmp_vmp"].collect()}
    assert found == {i: (html.unescape(n).strip(), None, None) for i, n in enumerate(names)}
    assert rows(tables["vmp_ont"]) == sorted([(str(i), str(i % 7)) for i in range(300)], key=repr)
    for g in dmd.LOOKUP_GROUPS:
        assert sorted((r.cd, r.descr if "descr" in r else r.desc) for r in tables[f"lookup_{g.lower()}"].collect()) == sorted((str(i), f"{g} {i}") for i in range(40))
    (tmp_path / "odd.xml").write_text("<A><!-- <VMP> --></A>")
    with pytest.raises(Exception, match="a comment with a tag"):
        dmd.xml_items(spark, str(tmp_path / "odd.xml"), "vmp")


def xml_items_of(text, file_id):
    """(group, texts of its fields) of a file, a tag at a time."""
    groups = dmd.table_fields(file_id)
    fields, found, opened = {f for own in groups.values() for f in own}, [], None
    for piece in text.split("<"):
        named = re.match(r"(?s)([A-Za-z_][\w.:-]*)(?:\s[^>]*)?>(.*)$", piece)
        if named is None:
            continue
        tag, value = named.groups()
        if tag == "INFO" if file_id == "lookup" else tag in groups:
            found.append((opened if file_id == "lookup" else tag, {}))
        elif tag in groups:
            opened = tag
        elif tag in fields and found:
            found[-1][1][tag] = html.unescape(value).strip(" \t\n\r\f\v") or None
    return [(g, tuple(told.get(f) for f in groups[g])) for g, told in found if g]


@pytest.mark.parametrize(("seed", "file_id", "batch"), [(1, "vmp", 3), (2, "lookup", 2), (3, "lookup", 10_000), (4, "ampp", 50)])
def test_xml_items_against_a_tag_at_a_time(spark, tmp_path, small_blocks, seed, file_id, batch):
    """Items, fields and groups cut by batches and blocks; fields twice, empty, closed at once, with attributes, unknown."""
    rng, groups = random.Random(seed), dmd.table_fields(file_id)
    fields = sorted({f for own in groups.values() for f in own})
    texts = ["", " \n", "x", " a b\n", "&amp;lt; &quot;", "&#65;&amp;", "\u00e9 &gt;\r", "]]", "\u00a0x ", "a\u2028", "&apos;]]&gt;", "word " * 60]

    def some_fields():
        return "".join(rng.choice([f"<{f}>{{}}</{f}>\n", f"<{f} a='1'>{{}}</{f}>", f"<{f}/>", f"<X{f}>{{}}</X{f}>", f"<{f}\n/>{{}}"]).format(rng.choice(texts)) for f in rng.choices(fields, k=rng.randrange(12)))

    wanted = []
    for i in range(3):
        begun = ["INFO"] * 4 + rng.sample([*groups], 2) if file_id == "lookup" else [*groups]
        text = "<?xml version='1.0'?>\n<ALL><!-- made -->" + some_fields() + "".join(f"<{g}>{some_fields()}</{g}>" for g in rng.choices(begun, k=150 if i else 0)) + "</ALL>"
        (tmp_path / f"{i}.xml").write_text(text, encoding="utf-8", newline="")
        wanted += xml_items_of(text, file_id)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        tables = dmd.xml_entities(spark, {file_id: str(tmp_path / "*.xml")})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = reduce(lambda a, b: a.unionByName(b), (tables[f"{file_id}_{g.lower()}"].select(F.lit(g).alias("g"), F.array(*(F.col(f"`{f.lower()}`") for f in own)).alias("texts")) for g, own in groups.items()))
    assert sorted(((r.g, tuple(r.texts)) for r in found.collect()), key=repr) == sorted(wanted, key=repr) and len(wanted) > 100


def test_xml_texts_with_usual_entities_need_no_parser(spark, tmp_path, monkeypatch):
    """A parser for each text took most of the time of a dictionary's load."""
    monkeypatch.setattr(F, "xpath_string", lambda *_: F.raise_error(F.lit("parsed")).cast("string"))
    (tmp_path / "v.xml").write_text("<A><VTM><VTMID>1</VTMID><NM> a &amp; b &amp;lt; &lt;c&gt; &quot;d&apos; </NM></VTM><VTM><VTMID>2</VTMID><NM>\u00e9 </NM></VTM></A>", encoding="utf-8")
    found = dmd.xml_entities(spark, {"vtm": str(tmp_path / "v.xml")})["vtm_vtm"]
    assert rows(found.select("vtmid", "nm")) == [("1", "a & b &lt; <c> \"d'"), ("2", "\u00e9")]
    (tmp_path / "odd.xml").write_text("<A><VTM><NM>a &unknown; b</NM></VTM></A>")
    with pytest.raises(Exception, match="parsed"):
        dmd.xml_items(spark, str(tmp_path / "odd.xml"), "vtm")


def test_job_folder_is_deleted(spark):
    with session.job_folder(spark) as folder:
        held = session.written(spark.range(3), "numbers")
        assert held.count() == 3 and session.path_exists(spark, folder)
    assert not session.path_exists(spark, folder)
    with session.job_folder(spark) as folder, pytest.raises(ZeroDivisionError):
        session.written(spark.range(3), "numbers")
        raise ZeroDivisionError
    assert not session.path_exists(spark, folder)


def test_snapshot_errors_are_not_swallowed(spark, tmp_path):
    folder = snapshots.SnapshotFolder(spark, str(tmp_path))
    assert folder.recorded() is None
    (tmp_path / "current").mkdir()
    (tmp_path / "current" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        folder.current()


def test_states_cross_runs_of_pieces(spark, tmp_path, monkeypatch):
    """What a task holds at once is a run of pieces, not a block; quotes and items cross runs."""
    monkeypatch.setattr("scriptline.sources.blocks._RUN_BITS", 2)
    path = tmp_path / "long.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\n""{i}\n\n,y"\n{i},z\n' for i in range(50)))
    found = archive.read_csv_strings(spark, str(path), multi_line=True)
    assert rows(found) == sorted([(str(i), f'x\n"{i}\n\n,y') for i in range(50)] + [(str(i), "z") for i in range(50)], key=repr)
    one_block = spark.range(100, numPartitions=1).selectExpr("'f' AS file", "0L AS block", "id AS at")
    counted = blocks.count_before(one_block, F.lit(1), "n")
    assert counted.where("n <> at").isEmpty() and counted.columns == ["file", "block", "at", "n"]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert all("_run" in x for x in plan.splitlines() if "Window" in x)


def test_a_filter_on_the_date_looks_at_the_name_once(spark, tmp_path):
    """A join on the date pushes such a filter to the scan, where no expression is shared."""
    from pyspark.sql import functions as F

    from scriptline.functions.filenames import path_date

    path = f"{tmp_path}/prescribing_2024-02-01_v3.parquet"
    spark.range(3).write.parquet(path)
    dated = spark.read.parquet(path).select("id", path_date(F.col("_metadata.file_path")).alias("date")).where("date is not null")
    plan = dated._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter" in line]
    assert len(kept) == 1 and kept[0].count("regexp_extract") == 1 and "split(" not in plan
    assert [str(r.date) for r in dated.collect()] == ["2024-02-01"] * 3
