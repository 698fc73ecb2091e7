import pytest
from pyspark.sql import functions as F

from conftest import CODES, rows
from scriptline.functions import bnf
from scriptline.operators import hierarchy, medications


def test_parts(spark):
    codes = spark.createDataFrame([("10",), ("1001030",), ("1001030U0BDABAC",), ("100",)], "code string")
    found = {r.code: tuple(r)[1:] for r in hierarchy.bnf_parts(codes).collect()}
    assert found["10"] == ("10",) + (None,) * 7
    assert found["1001030"] == ("10", "01", "03", "0") + (None,) * 4
    assert found["1001030U0BDABAC"] == ("10", "01", "03", "0", "U0", "BD", "AB", "AC")
    assert found["100"] == ("10", None, None, "0") + (None,) * 4


def test_strength_names(spark):
    df = spark.createDataFrame([("0101010G0AAABAB", "Generic Gaviscon tablets")], "code string, name string")
    found = df.select(bnf.strength_code(F.col("code")), bnf.strength_name(F.col("name")), bnf.generic_equivalent_code(F.col("code"))).first()
    assert tuple(found) == ("0101010G0_AB", "Gaviscon tablets", "0101010G0AAABAB")


def test_tree(codes):
    nodes = {r.code: (r.parent_code, r.depth, r.path) for r in hierarchy.bnf_tree(codes).collect()}
    assert set(nodes) == {code for code, level, _ in CODES if level <= 5}
    assert nodes["10"] == (None, 0, "10")
    assert nodes["1001030U0"] == ("1001030", 4, "10/1001/100103/1001030/1001030U0")


def test_product_table(codes):
    table = hierarchy.bnf_product_table(codes, "1001030U0")
    assert table.columns == ["row_code", "1001030U0AA", "1001030U0BD"]
    assert [(r[0], [tuple(c) for c in r[1]], [tuple(c) for c in r[2]]) for r in table.collect()] == [
        ("1001030U0_AB", [("1001030U0AAABAB", "Methotrexate 2.5mg tablets")], [("1001030U0BDAAAB", "Maxtrex 2.5mg tablets")]),
        ("1001030U0_AC", [("1001030U0AAACAC", "Methotrexate 10mg tablets")], [("1001030U0BDABAC", "Maxtrex 10mg tablets")]),
    ]
    no_generic = hierarchy.bnf_product_table(codes, "0601060D0").first()
    assert no_generic.row_code is None and [tuple(c) for c in no_generic[1]] == [("0601060D0BSAAA0", "Prestige Smart System testing strips")]


def test_presentation_without_a_cell_fails(spark, codes):
    odd = codes.unionByName(spark.createDataFrame([("1001030U0BDAZAZ", 7, "Odd")], "code string, level int, name string"))
    with pytest.raises(Exception, match="No single cell"):
        hierarchy.bnf_product_table(odd, "1001030U0").collect()


def test_selection_state(codes):
    state = {r.code: r for r in hierarchy.code_selection_state(codes, ["10", "0601060D0BS"], ["1001030U0BD"]).collect()}
    assert state["10"].directly_included and state["1001030U0"].included and not state["1001030U0"].directly_included
    assert state["1001030U0BDAAAB"].excluded and not state["1001030U0AAABAB"].excluded
    assert {c for c, r in state.items() if r.partially_included_chemical} == {"1001030U0", "0601060D0"}


def test_search(codes):
    assert {r.code for r in hierarchy.name_search(codes, "MAXTREX 1").collect()} == {"1001030U0BDABAC"}
    assert hierarchy.name_search(codes, "0601060d").count() == 3


def test_prescribed_medications_and_bnf_catalogue(spark, catalogue):
    recent = spark.createDataFrame([("1001030U0BDAAAB",)], "bnf_code string")
    prescribed = medications.medications_prescribed(catalogue.medications, recent)
    # The brand, and its virtual product, which has no recent code of its own.
    assert {r.id for r in prescribed.collect()} == {1, 3}
    only_brand = prescribed.where("is_amp")
    shown = rows(medications.catalog_bnf(only_brand, catalogue.codes).select("code", "level"))
    assert shown == sorted(
        [("10", 1), ("1001", 2), ("100103", 3), ("1001030", 4), ("1001030U0", 5), ("1001030U0_AB", 6), ("1001030U0BDAAAB", 7)], key=repr
    )


def test_index_date_itself_is_not_recent(spark):
    df = spark.createDataFrame([("a", "2017-04-01"), ("b", "2017-04-02")], "bnf_code string, d string")
    recent = medications.presentations_recent(df.select("bnf_code", F.col("d").cast("date").alias("last_prescribed_date")))
    assert rows(recent) == [("b",)]
