import random

import pytest

from scriptline.operators import facets
from scriptline.operators.facets import Selection


def found(catalogue, selection):
    return {r.id: r.status for r in facets.facet_query(catalogue.medications, selection).collect()}


def test_other_filter_alone_shows_its_matches(catalogue):
    assert found(catalogue, Selection(include={"form_route": ["solution.intravenous"]})) == {
        2: facets.CHILD_INCLUDED,  # added as the parent of the brand, then promoted
        4: facets.INCLUDED,
    }


def test_baseline_filters_are_alternatives_and_status_needs_all(catalogue):
    both = Selection(include={"ingredient": [101], "bnf": ["06"]})
    assert found(catalogue, both) == {2: "not_included", 4: "not_included", 5: "not_included", 6: "not_included"}


def test_exclusion_outweighs_inclusion(catalogue):
    status = found(catalogue, Selection(include={"vtm": [10]}, exclude={"form_route": ["solution.oral"]}))
    assert status == {1: "included", 2: "excluded", 3: "included", 4: "included"}


def test_missing_code_matches_nothing(catalogue):
    assert found(catalogue, Selection(include={"bnf": ["06"]})) == {5: "included", 6: facets.CHILD_INCLUDED}


def test_counts(catalogue):
    counts = facets.facet_counts(facets.facet_query(catalogue.medications, Selection(include={"vtm": [10]}))).first()
    assert tuple(counts) == (4, 2, 2)


def lookup(catalogue):
    ing = catalogue.ingredients.selectExpr("isid AS id", "nm AS name")
    vtm = catalogue.vtms.selectExpr("vtmid AS id", "nm AS name")
    return facets.facet_lookup(ing, vtm, catalogue.form_routes, catalogue.codes)


def options(catalogue, selection, facet, excluded=False):
    return {r.value for r in facets.facet_options(catalogue.medications, lookup(catalogue), selection, facet, excluded).collect()}


def test_options(catalogue):
    assert options(catalogue, Selection(), "ingredient") == {"100", "101"}
    picked = Selection(include={"bnf": ["1001030U0BD"]})
    assert options(catalogue, picked, "form_route") == {"tablet.oral", "solution.intravenous"}
    # A control does not narrow itself, only the others.
    assert options(catalogue, picked, "bnf") == {r.value for r in lookup(catalogue).where("facet = 'bnf'").collect()}
    narrowed = Selection(include={"bnf": ["1001030U0BD"], "form_route": ["tablet.oral"]})
    assert options(catalogue, narrowed, "ingredient", excluded=True) == {"100"}


def test_labels(catalogue):
    labels = {r.value: (r.label, r.sort_level) for r in lookup(catalogue).where("facet = 'bnf'").collect()}
    assert labels["1001030U0"] == ("Methotrexate (Chemical)", 5) and "1001030U0AAABAB" not in labels


def test_grouped(catalogue):
    statuses = facets.facet_query(catalogue.medications, Selection(include={"bnf": ["1001030U0BD", "06"]}))
    vmps = catalogue.medications.where("NOT is_amp").select("id", "name")
    vtms = catalogue.vtms.selectExpr("vtmid AS id", "nm AS name")
    rows = facets.medications_grouped(statuses, vtms, vmps).orderBy("vtm_name", "vtm_id", "vmp_name", "vmp_id", "is_amp", "name", "id").collect()
    assert [(r.vtm_name, r.vmp_name, r.name, r.vmp_status) for r in rows] == [
        ("Methotrexate", "Methotrexate 10mg tablets", "Methotrexate 10mg tablets", facets.CHILD_INCLUDED),
        ("Methotrexate", "Methotrexate 10mg tablets", "Maxtrex 10mg", facets.CHILD_INCLUDED),
        ("Methotrexate", "Methotrexate 2.5mg tablets", "Methotrexate 2.5mg tablets", facets.CHILD_INCLUDED),
        ("Methotrexate", "Methotrexate 2.5mg tablets", "Maxtrex 2.5mg", facets.CHILD_INCLUDED),
        ("No VTM", "Strips", "Strips", facets.CHILD_INCLUDED),
        ("No VTM", "Strips", "Prestige strips", facets.CHILD_INCLUDED),
    ]
    assert {r.vtm_status for r in rows} == {"not_included"}


def test_one_index_answers_every_selection(spark, catalogue):
    """Against the definition, on rows over several buckets; a product has two codes."""
    rng = random.Random(2)
    codes, forms = ["0101010A0AAABAB", "0101010A0BBAAAB", "0102030B0AAAAAA", "0201000C0AAACAC", None], ["a.x", "b.y", "c.z"]
    meds = [(i * 5000, rng.choice(codes), rng.choice([7, 8, None]), rng.sample(forms, rng.randint(0, 2)), rng.sample([1, 2, 3], rng.randint(0, 2))) for i in range(60)]
    meds += [(0, "0201000C0AAACAC", 7, ["a.x"], [1])]
    table = spark.createDataFrame(meds, "id bigint, bnf_code string, vtm_id bigint, form_routes array<string>, ingredient_ids array<bigint>")
    options = [("bnf", c[:n]) for c in codes if c for n in (2, 4, 6, 7, 9, 11)] + [("ingredient", str(i)) for i in (1, 2, 3, 4)] + [("vtm", "7"), ("vtm", "8"), ("vtm", "9")] + [("form_route", f) for f in [*forms, "d.w"]]
    known = spark.createDataFrame(sorted(set(options)), "facet string, value string").selectExpr("facet", "value", "value AS label", "0 AS sort_level")
    index = facets.bitmap_index(table, known)

    def has(row, facet, value):
        _, code, vtm, form, ingredients = row
        return {"bnf": code is not None and code.startswith(str(value)), "vtm": vtm == value, "form_route": value in form, "ingredient": value in ingredients}[facet]

    def expected(selection, facet, excluded):
        others = selection.without(facet, excluded)
        names = {v for f, v in options if f == facet}
        if others.is_empty():
            return names
        left = [r for r in meds if all(any(has(r, f, v) for v in vs) for f, vs in others.active().items()) and not any(has(r, f, v) for f, vs in others.exclude.items() for v in vs)]
        typed = int if facet in ("vtm", "ingredient") else str
        return {v for v in names if any(has(r, facet, typed(v)) for r in left)}

    chosen = {"bnf": ["01", "0201"], "vtm": [7], "form_route": ["a.x", "b.y"], "ingredient": [1, 3]}
    for include, exclude in (((), ("form_route",)), (("bnf",), ()), (("bnf", "form_route"), ("ingredient",)), (("vtm", "ingredient"), ("bnf", "form_route")), (("form_route",), ("form_route", "vtm"))):
        selection = Selection({f: chosen[f] for f in include}, {f: chosen[f][:1] for f in exclude})
        for facet in facets.FACETS:
            for excluded in (False, True):
                found = {r.value for r in index.options(selection, facet, excluded).collect()}
                assert found == expected(selection, facet, excluded), (include, exclude, facet, excluded)
    with pytest.raises(ValueError, match="codes of no level"):
        index.options(Selection({"bnf": ["010"]}), "vtm")


def test_index_has_no_more_than_the_values_there_are(spark):
    """Every code is a value of its own: its words hold its few rows, not all rows of a bucket."""
    number = 3000
    made = f"id, concat(lpad(cast(id % {number} AS string), 4, '0'), '010A0AAABAB') AS bnf_code, id % 2 AS vtm_id, array('a.x') AS form_routes, array(id % 5) AS ingredient_ids"
    meds = spark.sql(f"SELECT {made} FROM range({2 * number})")
    known = meds.selectExpr("'bnf' AS facet", "bnf_code AS value").distinct()
    index = facets.bitmap_index(meds, known)
    whole = index.bits.where("facet = 'bnf' AND length(value) = 15")
    assert number <= whole.count() <= 2 * number and whole.schema["bits"].dataType.simpleString() == "bigint"
    found = index.options(Selection({"vtm": [1], "ingredient": [3]}, {"form_route": ["b.y"]}), "bnf")
    assert {r.value for r in found.collect()} == {r.bnf_code for r in meds.where("vtm_id = 1 AND ingredient_ids[0] = 3").collect()}
