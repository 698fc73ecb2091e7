"""The canonical data set: two ICBs with two practices each, January to March 2025."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from scriptline.operators import orgs, star
from scriptline.operators.measures import Measure, measure_sides
from scriptline.operators.medicine_filter import MedicineFilter
from scriptline.plans import analysis
from scriptline.plans.analysis import Analysis
from scriptline.plans.model import ingest, model_from_sources, read_star, write_star

PRESENTATIONS = ["1001030U0AAABAB", "1001030U0AAACAC", "1001030U0BDAAAB", "1001030U0BDABAC"]
SOURCE = (
    "bnf_code string, snomed_code bigint, date date, practice_code string, quantity_value float, items int,"
    " quantity float, net_cost bigint, actual_cost bigint"
)
ALL = {"bnf_codes": ["1001030U0"]}
CASES = [
    ({"numerator": ALL}, None, 65.09, 64.15),
    ({"numerator": ALL}, "PRA00", 68.40, 66.41),
    ({"numerator": {**ALL, "bnf_codes_excluded": ["1001030U0AAABAB"]}}, None, 59.67, 59.07),
    ({"numerator": {"bnf_codes": ["1001030U0AA"]}, "denominator": ALL}, None, 27.77, 27.14),
]


def month(m):
    return datetime.date(2025, m, 1)


def source_row(date, practice, code, items):
    return (code, 0, date, practice, 0.0, items, 0.0, 100 * items, 50 * items)


def canonical(spark):
    source, sizes = [], []
    for i in range(2):
        for p in range(2):
            for m in (1, 2, 3):
                sizes.append((month(m), f"PRA{i}{p}", 1000 + 100 * i + 10 * p + m))
                source += [source_row(month(m), f"PRA{i}{p}", c, 8 * b + 4 * i + 2 * p + m) for b, c in enumerate(PRESENTATIONS)]
    return spark.createDataFrame(source, SOURCE), spark.createDataFrame(sizes, "date date, practice_code string, total bigint")


def organisations(spark):
    icbs = [(f"ICB0{i}", "icb", f"ICB {i}", False) for i in range(2)]
    practices = [(f"PRA{i}{p}", "pra", f"Practice {i}{p}", False) for i in range(2) for p in range(2)]
    found = spark.createDataFrame(icbs + practices, "id string, org_type string, name string, inactive boolean")
    edges = spark.createDataFrame([(p[0], f"ICB0{p[0][3]}") for p in practices], "child_id string, parent_id string")
    return found, orgs.org_practices(found, edges)


@pytest.fixture(scope="module", params=["sources", "star"])
def model(request, spark, catalogue, tmp_path_factory):
    source, sizes = canonical(spark)
    found, members = organisations(spark)
    if request.param == "sources":
        return model_from_sources(source, sizes, found, members, catalogue)
    path = str(tmp_path_factory.mktemp("star") / "v1")
    bnf = spark.createDataFrame([], "old_code string, new_code string")
    vmp = spark.createDataFrame([], "old_vpid bigint, new_vpid bigint")
    write_star(source, sizes, bnf, vmp, path)
    return read_star(spark, path, found, members, catalogue)


@pytest.mark.parametrize("query, org_id, ratio, decile", CASES)
def test_golden_values(model, query, org_id, ratio, decile):
    wanted = Analysis.from_dict({"queries": [query], "org_id": org_id})
    last = max(r.org for r in analysis.all_orgs(model, wanted).select("org").distinct().collect())
    found = analysis.all_orgs(model, wanted).where((F.col("org") == last) & (F.col("month") == "2025-01-01")).first()
    assert found.value == pytest.approx(ratio, 0.001)
    p90 = analysis.deciles(model, wanted).where("centile = 90 AND month = '2025-01-01'").first()
    assert p90.value == pytest.approx(decile, 0.001)
    series = analysis.org_series(model, wanted).where("month = '2025-01-01'").collect()
    assert [r.value for r in series] == ([] if org_id is None else [pytest.approx(51.94, 0.001)])


def test_unknown_organisation_fails(model):
    with pytest.raises(Exception, match="Unknown organisation"):
        analysis.all_orgs(model, Analysis(MedicineFilter(), org_id="NONE")).collect()


def test_round_trip():
    for query, org_id, _, _ in CASES:
        wanted = Analysis.from_dict({"queries": [query], "org_id": org_id})
        assert Analysis.from_dict(wanted.to_dict()) == wanted


def test_top_medications(model):
    everything = analysis.top_medications_other(model, MedicineFilter(bnf_codes=("1001030U0",)))
    assert {r.medication for r in everything.collect()} == {
        "Methotrexate 2.5mg tablets", "Methotrexate 10mg tablets", "Maxtrex 2.5mg tablets", "Maxtrex 10mg tablets",
    }
    two = analysis.top_medications_other(model, MedicineFilter(bnf_codes=("1001030U0",)), top_n=2)
    names = [(r.position, r.medication) for r in two.select("position", "medication").distinct().orderBy("position").collect()]
    assert names == [(1, "Maxtrex 10mg tablets"), (2, "Maxtrex 2.5mg tablets"), (3, "Other")]
    other = two.where("medication = 'Other' AND month = '2025-01-01'").first()
    # Codes 0 and 1 over four practices in January: sum of 8b + 4i + 2p + 1.
    assert other.value == sum(8 * b + 4 * i + 2 * p + 1 for b in (0, 1) for i in (0, 1) for p in (0, 1))


def test_measure_panel_agrees_with_single_ratios(model):
    measures = [
        Measure("generic", MedicineFilter(bnf_codes=("1001030U0AA",)), MedicineFilter(bnf_codes=("1001030U0",))),
        Measure("patients", MedicineFilter(bnf_codes=("1001030U0",), product_type="branded")),
        Measure("nothing", MedicineFilter(bnf_codes=("99",)), MedicineFilter(bnf_codes=("99",))),
    ]
    panel = {(r.measure, r.org_id, r.date): r.value for r in analysis.measure_panel(model, measures).collect()}
    assert len(panel) == 3 * 2 * 3
    for measure in measures:
        single = analysis.org_date_ratio(model, Analysis(measure.numerator, measure.denominator)).collect()
        assert {(measure.name, r.org_id, r.date): r.value for r in single} == {k: v for k, v in panel.items() if k[0] == measure.name}


def test_measure_definition():
    numerator = {"forms": ["tablet"], "bnf_codes": [""]}
    measure = Measure.from_dict("m", {"metadata": {"title": "T", "tags": ["a"]}, "queries": [{"numerator": numerator}]})
    assert analysis.measure_flags([measure]) == {"per_patient": ["m"], "placeholder": ["m"]}
    with pytest.raises(ValueError, match="form_routes"):
        Measure.from_dict("m", {"queries": [{"numerator": {"forms": ["a"], "form_routes": ["a.b"]}}]})


def test_value_selector(model):
    items = analysis.practice_date_matrix(model, MedicineFilter(bnf_codes=("1001030U0",)))
    cost = analysis.practice_date_matrix(model, MedicineFilter(bnf_codes=("1001030U0",)), value="actual_cost")
    assert {tuple(r) for r in cost.collect()} == {(r.practice_code, r.date, 50 * r.value) for r in items.collect()}


SPOT = [
    ("ABC123", 1, "1001030U0AAABAB", 99), ("OLD123", 1, "1001030U0AAABAB", 50), ("ABC123", 2, "1001030U0AAABAB", 15),
    ("ABC123", 2, "1001030U0AAABAB", 25), ("GHI123", 2, "1001030U0AAABAB", 40), ("ABC123", 2, "1001030U0AAACAC", 5),
    ("ABC123", 3, "1001030U0AAABAB", 10), ("DEF123", 3, "1001030U0AAABAB", 30), ("GHI123", 3, "1001030U0AAABAB", 15),
    ("-", 3, "1001030U0AAABAB", 1000), ("DEF123", 3, "0601060D0BSAAA0", 0),
]


def spot_model(spark, catalogue):
    source = spark.createDataFrame([source_row(month(m), p, c, n) for p, m, c, n in SPOT], SOURCE)
    sizes = spark.createDataFrame([(month(3), "ABC123", 7), (month(3), "OLD123", 9)], "date date, practice_code string, total bigint")
    return model_from_sources(source, sizes, *organisations(spark), catalogue)


def test_practice_matrix_of_two_months(spark, catalogue):
    found = analysis.practice_date_matrix(spot_model(spark, catalogue), MedicineFilter(bnf_codes=("1001030U0AAABAB",)), 2)
    assert rows(found) == sorted(
        [
            ("ABC123", month(3), 10), ("ABC123", month(2), 40), ("DEF123", month(3), 30), ("DEF123", month(2), 0),
            ("GHI123", month(3), 15), ("GHI123", month(2), 40),
        ], key=repr,
    )


def test_patients_of_inactive_practices_are_left_out(spark, catalogue):
    found = analysis.practice_date_matrix(spot_model(spark, catalogue), None, 2)
    assert {(r.practice_code, r.value) for r in found.where("date = '2025-03-01'").collect()} == {("ABC123", 7), ("DEF123", 0), ("GHI123", 0)}


def test_medication_matrix_drops_codes_without_prescribing(spark, catalogue):
    found = analysis.medication_date_matrix(spot_model(spark, catalogue), MedicineFilter(), 2)
    assert rows(found) == sorted(
        [
            ("1001030U0AAABAB", month(3), 55), ("1001030U0AAABAB", month(2), 80),
            ("1001030U0AAACAC", month(3), 0), ("1001030U0AAACAC", month(2), 5),
        ], key=repr,
    )


def test_stack_totals(spark):
    shown = spark.createDataFrame([("A", 1, 5), ("A", 2, 5), ("B", 1, 3), ("Other", 1, 7)], "medication string, month int, value bigint")

    def order(largest, other):
        return {r.medication: r.stack_order for r in analysis.stack_totals(shown, largest, other).collect()}

    assert order("top", "middle") == {"A": 10, "B": 3, "Other": 7}
    assert order("top", "top") == {"A": 10, "B": 3, "Other": 11}
    assert order("top", "bottom") == {"A": 10, "B": 3, "Other": 2}
    assert order("bottom", "top") == {"A": -10, "B": -3, "Other": -2}
    assert order("bottom", "bottom") == {"A": -10, "B": -3, "Other": -11}


def test_intersection(spark, catalogue, model):
    found = analysis.ntr_dtr_intersection(model, MedicineFilter(bnf_codes=("1001030U0AA",)), MedicineFilter(bnf_codes=("1001030U0_AB",)))
    assert [(r.code, r.ntr, r.dtr) for r in found.collect()] == [
        ("1001030U0AAABAB", True, True), ("1001030U0AAACAC", True, False), ("1001030U0BDAAAB", False, True),
    ]
    alone = analysis.ntr_dtr_intersection(model, MedicineFilter(bnf_codes=("1001030U0AA",)), None)
    assert [(r.code, r.ntr, r.dtr) for r in alone.collect()] == [("1001030U0AAABAB", True, None), ("1001030U0AAACAC", True, None)]


def test_ingest_runs_once_per_set_of_files(spark, tmp_path):
    source, sizes = canonical(spark)
    bnf = spark.createDataFrame([("1001030U0BDAAAB", "1001030U0AAABAB")], "old_code string, new_code string")
    vmp = spark.createDataFrame([], "old_vpid bigint, new_vpid bigint")
    files = spark.createDataFrame([("prescribing_2025-01-01_v3.parquet",)], "name string")
    root = str(tmp_path / "rx")

    def run(version, files, force=False):
        return ingest(spark, root, version, files, source, sizes, bnf, vmp, force)

    assert run("v1", files)
    assert not run("v2", files)
    assert run("v3", files, force=True)
    more = files.unionByName(spark.createDataFrame([("prescribing_2025-02-01_v3.parquet",)], "name string"))
    assert run("v4", more)
    presentation = spark.read.parquet(f"{root}/versions/v4/presentation")
    assert rows(presentation.select("id", "bnf_code", "original_bnf_code")) == [
        (1, "1001030U0AAABAB", "1001030U0AAABAB"), (2, "1001030U0AAACAC", "1001030U0AAACAC"),
        (3, "1001030U0AAABAB", "1001030U0BDAAAB"), (4, "1001030U0BDABAC", "1001030U0BDABAC"),
    ]
    assert spark.read.parquet(f"{root}/versions/v4/prescribing_norm").count() == source.count()


def test_code_mapped_twice_fails(spark):
    from scriptline.operators import star

    source, _ = canonical(spark)
    twice = spark.createDataFrame([("1001030U0BDAAAB", "A"), ("1001030U0BDAAAB", "B")], "old_code string, new_code string")
    vmp = spark.createDataFrame([], "old_vpid bigint, new_vpid bigint")
    with pytest.raises(Exception, match="Code mapped twice"):
        star.presentation_current_codes(star.presentations(source), twice, vmp).collect()


def test_measures_are_strict(spark, catalogue):
    side = {"numerator": {"bnf_codes": ["1001"]}}
    for wrong in (
        {"queries": [side], "metdata": {}},
        {"queries": [side], "metadata": {"titel": "T"}},
        {"queries": [side], "options": {"values": "items"}},
        {"queries": [{**side, "denominators": {}}]},
        {"queries": [{"numerator": {"bnf_code": ["1001"]}}]},
    ):
        with pytest.raises(ValueError, match="unknown keys"):
            Measure.from_dict("m", wrong)
    with pytest.raises(ValueError, match="output_value"):
        Measure.from_dict("m", {"queries": [side], "options": {"output_value": "packs"}})
    twice = [Measure.from_dict("m", {"queries": [side]})] * 2
    with pytest.raises(ValueError, match="measures of one name: m"):
        measure_sides(twice, catalogue)


def test_measures_sum_their_own_value(model):
    side = {"numerator": {"bnf_codes": ["1001030U0AA"]}, "denominator": ALL}
    measures = [Measure.from_dict(v, {"queries": [side], "options": {"output_value": v}}) for v in ("items", "cost")]
    found = {(r.measure, r.org_id, r.date): r for r in analysis.measure_panel(model, measures).collect()}
    assert len(found) == 12
    for (name, org, date), r in found.items():
        assert r.num == found["items", org, date].num * (50 if name == "cost" else 1) > 0


def fact_scans(spark, df):
    """Scans of the fact in the text of the final plan; those beneath reused stages are listed again."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    return [line for line in plan.split("\n") if re.search(r"FileScan parquet \[[^]]*\bpresentation_id#", line)]


def test_each_analysis_pushes_its_ids(spark, model):
    if not model.clustered:
        pytest.skip("facts on sources are no table")
    query = MedicineFilter.from_dict(ALL)
    ratio = Analysis(MedicineFilter(bnf_codes=("1001030U0AA",)), query)
    for found in (
        analysis.practice_date_matrix(model, query, 2),
        analysis.org_date_ratio(model, ratio, 2),
        analysis.deciles(model, ratio, 2),
        analysis.top_medications_other(model, query, 2),
        analysis.measure_panel(model, [Measure("m", ratio.numerator, query)], date_count=2),
    ):
        scans = fact_scans(spark, found)
        assert scans and all("presentation_id" in s.split("PushedFilters")[1] for s in scans)


def test_a_new_month_of_the_panel_reads_its_own_facts(spark, model, tmp_path):
    """Sums of all months but the newest, then of the newest alone: the panel is that of a full run."""
    measures = [Measure("generic", MedicineFilter(bnf_codes=("1001030U0AA",)), MedicineFilter.from_dict(ALL)), Measure("patients", MedicineFilter.from_dict(ALL), output_value="cost")]
    months = sorted(str(r["date"]) for r in model.dates.collect())
    path = str(tmp_path / "sums")
    analysis.write_org_sums(model, path, months=months[:-1])
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    read = []
    original = analysis.org_sums

    def watched(model, org_type, facts, columns):
        read.append({str(r["date"]) for r in facts.select("date").distinct().collect()})
        return original(model, org_type, facts, columns)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(analysis, "org_sums", watched)
        analysis.write_org_sums(model, path, months=months[-1:])
    assert read == [{months[-1]}] and all(f.stat().st_mtime_ns == t for f, t in before.items())
    kept = analysis.measure_panel(model, measures, sums_path=path)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, analysis.measure_panel(model, measures).collect()))
    if model.clustered:
        assert not fact_scans(spark, kept)


def test_id_ranges_leave_gaps_out(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 50, 51, 900, 250_000, 250_001)], "presentation_id long")
    assert analysis.id_ranges(ids) == [(1, 3), (50, 51), (900, 900), (250_000, 250_001)]
    assert analysis.id_ranges(ids, 2) == [(1, 900), (250_000, 250_001)]
    assert analysis.id_ranges(ids.limit(0)) == []


def test_star_reads_its_source_twice(spark, tmp_path):
    source, sizes = canonical(spark)
    source.write.parquet(f"{tmp_path}/source")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = spark.read.parquet(f"{tmp_path}/source")
    rows_there = watched.count()
    no_codes = spark.createDataFrame([], "old_code string, new_code string")
    no_vmps = spark.createDataFrame([], "old_vpid bigint, new_vpid bigint")
    write_star(watched.mapInArrow(counted, source.schema), sizes, no_codes, no_vmps, f"{tmp_path}/star")
    assert seen.value == 2 * rows_there
    assert spark.read.parquet(f"{tmp_path}/star/prescribing_norm").count() == rows_there


def test_star_counts_months_of_large_presentations_only(spark, tmp_path, monkeypatch):
    """Keys are rows per presentation, practice and month; one that is larger than a range is still cut by month."""
    code = F.when(F.col("id") % 2 == 0, "0101010A0AAABAB").otherwise(F.format_string("02%05d0AAABAB", F.col("id") % 40))
    source = spark.range(4000).select(
        code.alias("bnf_code"), F.lit(0).cast("bigint").alias("snomed_code"), F.expr("add_months(date'2024-01-01', cast(id % 12 AS int))").alias("date"),
        F.format_string("P%03d", F.col("id") % 97).alias("practice_code"), F.lit(1.0).cast("float").alias("quantity_value"), F.lit(1).alias("items"),
        F.lit(1.0).cast("float").alias("quantity"), F.lit(1).cast("bigint").alias("net_cost"), F.lit(1).cast("bigint").alias("actual_cost"),
    )
    assert star.source_keys(source).count() == 21 + 97 + 12
    monkeypatch.setattr("scriptline.plans.model.range_number", lambda rows, cores: 16)
    sizes = source.select("date", "practice_code", F.lit(5).cast("bigint").alias("total")).distinct()
    write_star(source, sizes, spark.createDataFrame([], "old_code string, new_code string"), spark.createDataFrame([], "old_vpid bigint, new_vpid bigint"), f"{tmp_path}/star")
    fact = spark.read.parquet(f"{tmp_path}/star/prescribing_norm")
    spans = fact.groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.struct("presentation_id", "date_id")).alias("low"), F.max(F.struct("presentation_id", "date_id")).alias("high"), F.count("*").alias("n")
    ).orderBy("low", "high").collect()
    assert sum(s.n for s in spans) == 4000 and max(s.n for s in spans) < 800 and len(spans) > 8
    assert all(tuple(a.high) <= tuple(b.low) for a, b in zip(spans, spans[1:]))
    assert sum(s.low.presentation_id == 1 for s in spans) > 4
