"""The medicine filter and the code algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle import codes_where, of_medications, sql
from checks.registry import query
from scriptline.functions import bnf
from scriptline.operators import hierarchy, medicine_filter, orgs
from scriptline.operators.measures import Measure, measure_code_bridge
from scriptline.operators.medicine_filter import MedicineFilter, matching_codes

# Each filter with the condition on presentations it stands for.
PREFIX = "(starts_with(code, '01') OR starts_with(code, '0203'))"
GENERIC = "substr(code, 10, 2) = 'AA'"
RINGS = of_medications("list_has_any(form_routes, ['ring.small', 'bolt.red'])")
INGREDIENT = of_medications("list_has_any(ingredient_ids, [5, 103])")
MOIETY = of_medications("vtm_id IN (1003, 1011)")
FILTERS = {
    "filter_code_prefix": (MedicineFilter(bnf_codes=("01", "0203")), PREFIX),
    "filter_strength_formulation": (
        MedicineFilter(bnf_codes=("0102010L0_AA", "0103080C0_AB", "0209000K0_AC", "05")),
        """(starts_with(code, '0102010L0') AND ends_with(code, 'AA') OR starts_with(code, '0103080C0') AND ends_with(code, 'AB')
            OR starts_with(code, '0209000K0') AND ends_with(code, 'AC') OR starts_with(code, '05'))""",
    ),
    "filter_code_excluded": (
        MedicineFilter(bnf_codes_excluded=("02", "0104", "0102010L0_AA")),
        """NOT (starts_with(code, '02') OR starts_with(code, '0104')
            OR starts_with(code, '0102010L0') AND ends_with(code, 'AA'))""",
    ),
    "filter_product_type": (MedicineFilter(product_type="branded"), f"NOT {GENERIC}"),
    "filter_product_type_generic": (MedicineFilter(product_type="generic"), GENERIC),
    "filter_form_route": (MedicineFilter(form_routes=("ring.small", "bolt.red")), RINGS),
    "filter_form_route_excluded": (MedicineFilter(form_routes_excluded=("ring.small", "bolt.red")), f"NOT {RINGS}"),
    "filter_forms_routes": (
        MedicineFilter(forms=("ring",), routes=("red",), form_routes=("bolt.cold",)),
        of_medications("list_has_any(form_routes, ['bolt.cold', 'ring.red'])"),
    ),
    "filter_forms_unmatched": (MedicineFilter(forms=("ring", "bolt"), bnf_codes=("01",)), "starts_with(code, '01')"),
    "filter_ingredient": (MedicineFilter(ingredient_ids=(5, 103)), INGREDIENT),
    "filter_ingredient_excluded": (MedicineFilter(ingredient_ids_excluded=(5, 103)), f"NOT {INGREDIENT}"),
    "filter_vtm": (MedicineFilter(vtm_ids=(1003, 1011)), MOIETY),
    "filter_vtm_excluded": (MedicineFilter(vtm_ids_excluded=(1003, 1011)), f"NOT {MOIETY}"),
}
WHOLE = MedicineFilter(
    bnf_codes=("01", "02", "03"),
    bnf_codes_excluded=("0104",),
    product_type="generic",
    form_routes=("ring.small",),
    forms=("bolt",),
    routes_excluded=("blue",),
    ingredient_ids=(5, 101, 102, 103),
    vtm_ids_excluded=(1003,),
)
WHOLE_SQL = f"""(starts_with(code, '01') OR starts_with(code, '02') OR starts_with(code, '03')) AND NOT starts_with(code, '0104')
    AND {GENERIC}
    AND {of_medications("list_contains(form_routes, 'ring.small') OR len(list_filter(form_routes, lambda r: starts_with(r, 'bolt.'))) > 0")}
    AND NOT {of_medications("len(list_filter(form_routes, lambda r: ends_with(r, '.blue'))) > 0")}
    AND {of_medications("list_has_any(ingredient_ids, [5, 101, 102, 103])")}
    AND NOT {of_medications("vtm_id = 1003")}"""


def _register(name: str, wanted: MedicineFilter, condition: str) -> None:
    @query(name, sql(codes_where(condition)))
    def _(s):
        return matching_codes(wanted, s.catalogue)


for _name, (_wanted, _condition) in FILTERS.items():
    _register(_name, _wanted, _condition)


@query("matching_codes", sql(codes_where(WHOLE_SQL)))
def _(s):
    return matching_codes(WHOLE, s.catalogue).orderBy("code")


@query("expand_forms_routes", sql("SELECT descr FROM m_form_route WHERE starts_with(descr, 'ring.') AND ends_with(descr, '.red')"))
def _(s):
    return medicine_filter.expand_forms_routes(s.table("form_route"), ("ring",), ("red",))


RX_ITEMS = f"SELECT bnf_code, practice_code, date, items AS value FROM rx WHERE bnf_code IN ({codes_where(WHOLE_SQL)})"


@query("prescribing_items", sql(f"SELECT bnf_code, practice_code, CAST(date AS VARCHAR) AS date, value FROM ({RX_ITEMS})"))
def _(s):
    model = s.model
    view = model.facts.join(model.presentation.select(F.col("id").alias("presentation_id"), "bnf_code"), "presentation_id")
    found = medicine_filter.prescribing_items(view, matching_codes(WHOLE, s.catalogue))
    return found.withColumn("date", F.col("date").cast("string"))


@query("list_size_items", sql("SELECT practice_code, CAST(date AS VARCHAR) AS date, total AS value FROM lists"))
def _(s):
    return medicine_filter.list_size_items(s.list_sizes).withColumn("date", F.col("date").cast("string"))


CHECKED = MedicineFilter(
    bnf_codes=("01", "99", "0102010L0_AA", "0102010L0_ZZ", "bad_code"),
    bnf_codes_excluded=("0104", "98"),
    form_routes=("ring.small", "ring.none"),
    forms=("ring", "cube"),
    routes=("red", "none"),
    ingredient_ids=(5, 999),
    vtm_ids=(1003, 1),
)


@query(
    "query_validate",
    sql(
        """SELECT g.field, g.value FROM (VALUES
             ('bnf_codes', '01'), ('bnf_codes', '99'), ('bnf_codes', '0102010L0_AA'), ('bnf_codes', '0102010L0_ZZ'),
             ('bnf_codes', 'bad_code'), ('bnf_codes_excluded', '0104'), ('bnf_codes_excluded', '98'),
             ('form_routes', 'ring.small'), ('form_routes', 'ring.none'), ('forms', 'ring'), ('forms', 'cube'),
             ('routes', 'red'), ('routes', 'none'), ('ingredient_ids', '5'), ('ingredient_ids', '999'),
             ('vtm_ids', '1003'), ('vtm_ids', '1')) g(field, value)
           WHERE NOT CASE
             WHEN starts_with(field, 'bnf_codes') THEN EXISTS (SELECT 1 FROM pres WHERE starts_with(pres.code, g.value)
                  OR substr(pres.code, 1, 9) || '_' || right(pres.code, 2) = g.value)
             WHEN field = 'form_routes' THEN g.value IN (SELECT descr FROM m_form_route)
             WHEN field = 'forms' THEN g.value IN (SELECT split_part(descr, '.', 1) FROM m_form_route)
             WHEN field = 'routes' THEN g.value IN (SELECT split_part(descr, '.', 2) FROM m_form_route)
             WHEN field = 'ingredient_ids' THEN g.value IN (SELECT CAST(isid AS VARCHAR) FROM m_ing)
             ELSE g.value IN (SELECT CAST(vtmid AS VARCHAR) FROM m_vtm) END"""
    ),
)
def _(s):
    return medicine_filter.query_validate(CHECKED, s.catalogue)


@query(
    "query_describe",
    sql(
        """SELECT g.field, g.position, g.value, CASE
             WHEN g.field = 'bnf_codes' THEN
               (SELECT min(name) FROM codes WHERE code = substr(g.value, 1, 9) || 'AA' || right(g.value, 2) || right(g.value, 2)) || ' (branded and generic)'
             WHEN g.field = 'bnf_codes_excluded' THEN (SELECT min(name) FROM codes WHERE code = g.value)
             WHEN g.field = 'ingredient_ids' THEN (SELECT min(nm) FROM m_ing WHERE CAST(isid AS VARCHAR) = g.value)
             WHEN g.field = 'vtm_ids_excluded' THEN (SELECT min(nm) FROM m_vtm WHERE CAST(vtmid AS VARCHAR) = g.value)
             ELSE g.value END AS description
           FROM (SELECT 'form_routes' AS field, 0 AS position, 'ring.small' AS value
                 UNION ALL SELECT 'bnf_codes_excluded', 0, min(code) FROM codes WHERE level = 2
                 UNION ALL SELECT 'ingredient_ids', 0, CAST(min(isid) AS VARCHAR) FROM m_ing
                 UNION ALL SELECT 'ingredient_ids', 1, CAST(max(isid) AS VARCHAR) FROM m_ing
                 UNION ALL SELECT 'vtm_ids_excluded', 0, CAST(min(vtmid) AS VARCHAR) FROM m_vtm
                 UNION ALL SELECT 'bnf_codes', 0, min(substr(code, 1, 9) || '_' || right(code, 2)) FROM pres WHERE substr(code, 10, 2) = 'AA') g"""
    ),
)
def _(s):
    # The first and last entries of the catalogues are described, so the check works on any scale.
    codes, code = s.catalogue.codes, F.col("code")
    generics = s.catalogue.presentations().where(bnf.is_generic(code))
    ids = s.catalogue.ingredients.agg(F.min("isid"), F.max("isid")).first()
    wanted = MedicineFilter(
        bnf_codes=(generics.agg(F.min(bnf.strength_code(code))).first()[0],),
        bnf_codes_excluded=(codes.where("level = 2").agg(F.min("code")).first()[0],),
        form_routes=("ring.small",),
        ingredient_ids=tuple(ids),
        vtm_ids_excluded=(s.catalogue.vtms.agg(F.min("vtmid")).first()[0],),
    )
    return medicine_filter.query_describe(wanted, s.catalogue)


MEASURES = [
    Measure("generic_share", MedicineFilter(bnf_codes=("01", "02"), product_type="generic"), MedicineFilter(bnf_codes=("01", "02"))),
    Measure("rings", MedicineFilter(form_routes=("ring.small", "bolt.red")), MedicineFilter(bnf_codes=("",))),
    Measure("rings_by_form", MedicineFilter(forms=("ring",), routes=("red",), bnf_codes_excluded=("0104",))),
    Measure("unmatched_form", MedicineFilter(forms=("ring", "bolt"), bnf_codes=("03",))),
    Measure("ingredients", MedicineFilter(ingredient_ids=(5, 103), vtm_ids_excluded=(1003,)), MedicineFilter(ingredient_ids=(5, 103))),
    Measure("whole", WHOLE, MedicineFilter(bnf_codes=("01", "02", "03"), product_type="branded")),
]
SIDES = [
    ("generic_share", "numerator", f"(starts_with(code, '01') OR starts_with(code, '02')) AND {GENERIC}"),
    ("generic_share", "denominator", "(starts_with(code, '01') OR starts_with(code, '02'))"),
    ("rings", "numerator", RINGS),
    ("rings", "denominator", "true"),
    ("rings_by_form", "numerator", of_medications("list_contains(form_routes, 'ring.red')") + " AND NOT starts_with(code, '0104')"),
    ("unmatched_form", "numerator", "starts_with(code, '03')"),
    ("ingredients", "numerator", f"{INGREDIENT} AND NOT {of_medications('vtm_id = 1003')}"),
    ("ingredients", "denominator", INGREDIENT),
    ("whole", "numerator", WHOLE_SQL),
    ("whole", "denominator", f"(starts_with(code, '01') OR starts_with(code, '02') OR starts_with(code, '03')) AND NOT {GENERIC}"),
]
BRIDGE = " UNION ALL ".join(
    f"SELECT '{measure}' AS measure, '{side}' AS side, code AS bnf_code FROM pres WHERE {condition}" for measure, side, condition in SIDES
)


@query("measure_code_bridge", sql(BRIDGE))
def _(s):
    return measure_code_bridge(MEASURES, s.catalogue)


# Code algebra ---------------------------------------------------------------------------------------------
def _part(start: int, width: int, name: str) -> str:
    return f"CASE WHEN length(code) >= {start + width - 1} THEN substr(code, {start}, {width}) END AS {name}"


_PARTS = ", ".join(
    _part(start, width, name)
    for start, width, name in (
        (1, 2, "chapter"), (3, 2, "section"), (5, 2, "paragraph"), (7, 1, "subparagraph"), (8, 2, "chemical_substance"),
        (10, 2, "product"), (12, 2, "strength_and_formulation"), (14, 2, "generic_equivalent"),
    )
)


@query("bnf_parts", sql(f"SELECT code, {_PARTS} FROM codes"))
def _(s):
    return hierarchy.bnf_parts(s.codes)


@query("bnf_is_generic", sql(f"SELECT code, {GENERIC} AS is_generic FROM codes WHERE level >= 6"))
def _(s):
    return s.codes.where("level >= 6").select("code", bnf.is_generic(F.col("code")).alias("is_generic"))


@query("bnf_ancestors", sql("SELECT b.code, a.code AS ancestor FROM codes a JOIN codes b ON starts_with(b.code, a.code) AND b.code <> a.code"))
def _(s):
    return hierarchy.bnf_ancestors(s.codes)


@query("bnf_descendants", sql("SELECT code FROM codes WHERE starts_with(code, '0103') AND code <> '0103'"))
def _(s):
    return hierarchy.bnf_descendants(s.codes, "0103")


@query(
    "bnf_generic_equivalents",
    sql(f"""SELECT p.code, g.code AS generic_code FROM pres p JOIN (SELECT code FROM pres WHERE {GENERIC}) g
            ON substr(p.code, 1, 9) = substr(g.code, 1, 9) AND substr(p.code, 14, 2) = substr(g.code, 12, 2)"""),
)
def _(s):
    return hierarchy.bnf_generic_equivalents(s.codes)


@query("bnf_generic_equivalent_code", sql("SELECT code, substr(code, 1, 9) || 'AA' || right(code, 2) || right(code, 2) AS generic_code FROM pres"))
def _(s):
    return s.catalogue.presentations().select("code", bnf.generic_equivalent_code(F.col("code")).alias("generic_code"))


@query(
    "bnf_strength_formulation",
    sql(f"""SELECT code, substr(code, 1, 9) || '_' || right(code, 2) AS strength_code,
                   CASE WHEN starts_with(name, 'Generic ') THEN substr(name, 9) ELSE name END AS strength_name
            FROM pres WHERE {GENERIC}"""),
)
def _(s):
    generic = s.catalogue.presentations().where(bnf.is_generic(F.col("code")))
    return generic.select("code", bnf.strength_code(F.col("code")).alias("strength_code"), bnf.strength_name(F.col("name")).alias("strength_name"))


@query(
    "bnf_code_names",
    sql(f"""SELECT code, name FROM codes WHERE level <= 5 UNION ALL
            SELECT substr(code, 1, 9) || '_' || right(code, 2), CASE WHEN starts_with(name, 'Generic ') THEN substr(name, 9) ELSE name END
            FROM pres WHERE {GENERIC}"""),
)
def _(s):
    return hierarchy.bnf_code_names(s.codes)


_INC, _EXC = ["01", "0203", "0301010L0"], ["0104", "020301", "0102010L0"]


def _any(template: str, values: list[str]) -> str:
    return "(" + " OR ".join(template.format(v=v) for v in values) + ")"


_BELOW = "(starts_with('{v}', code) AND code <> '{v}')"


@query(
    "code_selection_state",
    sql(f"""SELECT code, {_any("code = '{v}'", _INC)} AS directly_included, {_any("code = '{v}'", _EXC)} AS directly_excluded,
                   {_any("starts_with(code, '{v}')", _INC)} AS included, {_any("starts_with(code, '{v}')", _EXC)} AS excluded,
                   length(code) = 9 AND ({_any(_BELOW, _INC)} OR {_any(_BELOW, _EXC)}) AS partially_included_chemical FROM codes"""),
)
def _(s):
    return hierarchy.code_selection_state(s.codes, _INC, _EXC)


@query("name_search", sql("""SELECT code, level, name FROM codes
    WHERE starts_with(lower(code), '0103') OR contains(lower(name), '0103') OR contains(lower(name), 'paragraph 02')"""))
def _(s):
    return hierarchy.name_search(s.codes, "0103").unionByName(hierarchy.name_search(s.codes, "PARAGRAPH 02")).distinct()


@query("search_orgs", sql("""SELECT id, org_type, name FROM orgs
    WHERE contains(lower(name), 'icb') OR contains(lower(id), 'icb') OR contains(lower(name), 'sic03') OR contains(lower(id), 'sic03')"""))
def _(s):
    found = orgs.search_orgs(s.orgs, " Icb ").unionByName(orgs.search_orgs(s.orgs, "sic03")).unionByName(orgs.search_orgs(s.orgs, "x"))
    return found.select("id", "org_type", "name").distinct()
