import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from conftest import rows
from scriptline.operators import measures, medicine_filter
from scriptline.operators.measures import Measure, measure_code_bridge
from scriptline.operators.medicine_filter import LIST_FIELDS, MedicineFilter, matching_codes

GENERIC_2, GENERIC_10 = "1001030U0AAABAB", "1001030U0AAACAC"
BRAND_2, BRAND_10 = "1001030U0BDAAAB", "1001030U0BDABAC"
STRIPS = "0601060D0BSAAA0"
EVERYTHING = {GENERIC_2, GENERIC_10, BRAND_2, BRAND_10, STRIPS}

CASES = [
    ({}, EVERYTHING),
    ({"bnf_codes": ["10"]}, EVERYTHING - {STRIPS}),
    ({"bnf_codes": ["06", "1001030U0AA"]}, {STRIPS, GENERIC_2, GENERIC_10}),
    ({"bnf_codes": ["1001030U0_AB"]}, {GENERIC_2, BRAND_2}),
    ({"bnf_codes": ["1001030U0"], "bnf_codes_excluded": ["1001030U0_AB"]}, {GENERIC_10, BRAND_10}),
    ({"bnf_codes": [""]}, EVERYTHING),
    ({"bnf_codes": ["99"]}, set()),
    ({"product_type": "generic"}, {GENERIC_2, GENERIC_10}),
    ({"product_type": "branded"}, {BRAND_2, BRAND_10, STRIPS}),
    ({"form_routes": ["tablet.oral"]}, {GENERIC_2, GENERIC_10, BRAND_2}),
    ({"form_routes": ["tablet.oral"], "product_type": "branded"}, {BRAND_2}),
    ({"form_routes": ["nothing.here"]}, set()),
    ({"form_routes_excluded": ["tablet.oral"]}, {BRAND_10, STRIPS}),
    ({"routes": ["oral"]}, {GENERIC_2, GENERIC_10, BRAND_2}),
    ({"forms": ["solution"]}, {GENERIC_10, BRAND_10}),
    ({"forms": ["solution"], "routes": ["oral"]}, {GENERIC_10}),
    ({"forms": ["solution"], "form_routes": ["tablet.oral"]}, {GENERIC_2, GENERIC_10, BRAND_2, BRAND_10}),
    ({"forms": ["solution", "tablet"]}, EVERYTHING),  # fits nothing, so it does not filter
    ({"routes": ["nasal"]}, EVERYTHING),
    ({"routes_excluded": ["oral"]}, {BRAND_10, STRIPS}),
    ({"routes_excluded": ["nasal"]}, EVERYTHING),
    ({"ingredient_ids": [101]}, {GENERIC_10, BRAND_10}),
    ({"ingredient_ids": [999]}, set()),
    ({"ingredient_ids": [100, 101], "ingredient_ids_excluded": [100]}, {BRAND_10}),
    ({"vtm_ids": [10]}, EVERYTHING - {STRIPS}),
    ({"vtm_ids_excluded": [10]}, {STRIPS}),
    ({"vtm_ids": [10], "ingredient_ids": [100], "forms": ["tablet"], "product_type": "generic"}, {GENERIC_2, GENERIC_10}),
]


@pytest.mark.parametrize("values, expected", CASES, ids=[str(c[0]) for c in CASES])
def test_matching_codes(catalogue, values, expected):
    assert {r.code for r in matching_codes(MedicineFilter.from_dict(values), catalogue).collect()} == expected


def test_malformed_values():
    with pytest.raises(ValueError, match="strength and formulation"):
        medicine_filter.code_predicate(MedicineFilter(bnf_codes=("bad_code",)), None)
    with pytest.raises(ValueError, match="product_type"):
        MedicineFilter(product_type="other")


def test_validate(catalogue):
    wrong = MedicineFilter(
        bnf_codes=("1001", "99", "1001030U0_AB", "1001030U0_ZZ", "bad_code"),
        forms=("tablet", "cream"),
        routes_excluded=("oral", "nasal"),
        form_routes=("tablet.oral", "tablet.nasal"),
        ingredient_ids_excluded=(100, 7),
        vtm_ids=(10, 11),
    )
    assert {tuple(r) for r in medicine_filter.query_validate(wrong, catalogue).collect()} == {
        ("bnf_codes", "99"), ("bnf_codes", "1001030U0_ZZ"), ("bnf_codes", "bad_code"), ("forms", "cream"),
        ("routes_excluded", "nasal"), ("form_routes", "tablet.nasal"), ("ingredient_ids_excluded", "7"), ("vtm_ids", "11"),
    }
    assert medicine_filter.query_validate(MedicineFilter(bnf_codes=("10",)), catalogue).isEmpty()


def test_validation_broadcasts_the_filter_not_the_catalogue(spark, catalogue):
    """Only what the filter gives, and what is met of it, is broadcast; the keys of all codes are streamed."""
    query = MedicineFilter(bnf_codes=("1001", "99", "99"))
    found = medicine_filter.query_validate(query, catalogue)
    assert rows(found) == [("bnf_codes", "99"), ("bnf_codes", "99")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    semi = plan[plan.index("LeftSemi") :]
    assert "rightHint=(strategy=broadcast)" in semi.splitlines()[0] and plan.index("LeftAnti") < plan.index("Aggregate") < plan.index("LeftSemi")


def test_describe(catalogue):
    def described(**values):
        return {(r.field, r.position): r.description for r in medicine_filter.query_describe(MedicineFilter(**values), catalogue).collect()}

    assert described(bnf_codes=("1001030U0_AB", "10"), forms=("tablet",), ingredient_ids=(100,), vtm_ids_excluded=(10,)) == {
        ("bnf_codes", 0): "Methotrexate 2.5mg tablets (branded and generic)",
        ("bnf_codes", 1): "Musculoskeletal and Joint Diseases",
        ("forms", 0): "tablet",
        ("ingredient_ids", 0): "Methotrexate",
        ("vtm_ids_excluded", 0): "Methotrexate",
    }
    assert described(bnf_codes=("1001030U0_AB",), product_type="generic") == {("bnf_codes", 0): "Methotrexate 2.5mg tablets"}
    with pytest.raises(Exception, match="Unknown value"):
        described(bnf_codes=("77",))


@given(st.fixed_dictionaries({}, optional={n: st.lists(st.integers(0, 9), max_size=3) for n in LIST_FIELDS} | {"product_type": st.sampled_from(["all", "generic", "branded"])}))
def test_round_trip(values):
    query = MedicineFilter.from_dict(values)
    assert MedicineFilter.from_dict(query.to_dict()) == query


def test_unknown_fields_fail():
    with pytest.raises(ValueError, match="unknown keys in filter: bnf_code"):
        MedicineFilter.from_dict({"bnf_code": ["0501"]})


def test_validation_lists_a_wrong_product_type(catalogue):
    found = medicine_filter.query_validate({"product_type": "cheap", "bnf_codes": ["99"]}, catalogue)
    assert rows(found) == [("bnf_codes", "99"), ("product_type", "cheap")]


def test_all_filters_at_once(catalogue):
    """Filters as rows select what each selects by itself."""
    queries = {f"{i}": MedicineFilter.from_dict(q) for i, (q, _) in enumerate(CASES)}
    values = {
        "bnf_codes": ["06", "1001030U0BD", "1001030U0_AB", ""], "form_routes": ["tablet.oral", "solution.intravenous"], "forms": ["tablet", "solution", "none"],
        "routes": ["oral", "intravenous"], "ingredient_ids": [100, 101, 7], "vtm_ids": [10, 11],
    }
    rng = random.Random(4)
    for i in range(150):
        fields = {f + suffix: rng.sample(v, rng.randint(1, 2)) for f, v in values.items() for suffix in ("", "_excluded") if rng.random() < 0.2}
        queries[f"r{i}"] = MedicineFilter.from_dict(fields | {"product_type": rng.choice(["all", "all", "generic", "branded"])})
    found = sorted(tuple(r) for r in medicine_filter.filter_hits(queries, catalogue).collect())
    flags = medicine_filter.filter_flags(queries, catalogue).collect()
    assert found == sorted((r.code, n) for r in flags for n in queries if r[n])
    for i, (_, expected) in enumerate(CASES):
        assert {c for c, n in found if n == f"{i}"} == expected


def test_the_plan_does_not_grow_with_the_measures(catalogue):
    def plan(number):
        many = [Measure(f"m{i}", MedicineFilter(bnf_codes=("1001", f"{i:02d}"), forms=("tablet",), ingredient_ids_excluded=(i,)), MedicineFilter()) for i in range(number)]
        bridge = measure_code_bridge(many, catalogue)
        return bridge, len(bridge._jdf.queryExecution().optimizedPlan().toString())

    few, size = plan(2)
    many, larger = plan(1000)
    assert larger < 1.05 * size + 200
    assert few.where("side = 'denominator'").count() == 2 * len(EVERYTHING) and many.count() > 1000 * len(EVERYTHING)


def test_few_and_many_measures_have_the_same_sides(catalogue, monkeypatch):
    chosen = [Measure(f"m{i}", MedicineFilter.from_dict(q), MedicineFilter.from_dict(CASES[-1 - i][0])) for i, (q, _) in enumerate(CASES)][:10]

    def found():
        return {r.code: sorted(map(tuple, r.sides)) for r in measures.measure_sides(chosen, catalogue).collect()}

    few = found()
    monkeypatch.setattr(measures, "FLAGGED", 0)
    assert few and found() == few
