"""Declarative medicine filter: values in a field are alternatives, fields are combined, exclusions remove."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.functions import bnf
from scriptline.session import local_rows

ALL, GENERIC, BRANDED = PRODUCT_TYPES = ("all", "generic", "branded")
ID_FIELDS = ("ingredient_ids", "vtm_ids")
EXCLUDED = "_excluded"


@dataclass(frozen=True)
class Catalogue:
    """The reference tables filters are resolved against.

    codes (code, level, name), medications (see operators.medications), form_routes (descr), ingredients
    (isid, nm), vtms (vtmid, nm).
    """

    codes: DataFrame
    medications: DataFrame
    form_routes: DataFrame
    ingredients: DataFrame | None = None
    vtms: DataFrame | None = None

    def presentations(self) -> DataFrame:
        return self.codes.where(F.col("level") == bnf.PRESENTATION)


@dataclass(frozen=True)
class MedicineFilter:
    bnf_codes: tuple[str, ...] = ()
    bnf_codes_excluded: tuple[str, ...] = ()
    product_type: str = ALL
    form_routes: tuple[str, ...] = ()
    form_routes_excluded: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    forms_excluded: tuple[str, ...] = ()
    routes: tuple[str, ...] = ()
    routes_excluded: tuple[str, ...] = ()
    ingredient_ids: tuple[int, ...] = ()
    ingredient_ids_excluded: tuple[int, ...] = ()
    vtm_ids: tuple[int, ...] = ()
    vtm_ids_excluded: tuple[int, ...] = ()

    def __post_init__(self):
        if self.product_type not in PRODUCT_TYPES:
            raise ValueError(f"product_type: {self.product_type!r}")
        for name in LIST_FIELDS:
            kind = int if name.removesuffix(EXCLUDED) in ID_FIELDS else str
            object.__setattr__(self, name, tuple(kind(v) for v in getattr(self, name)))

    @classmethod
    def from_dict(cls, values: dict) -> MedicineFilter:
        """A filter from its fields; a field that does not exist fails, since leaving it out would select more."""
        refuse_unknown(values, {f.name for f in fields(cls)}, "filter")
        return cls(**values)

    def to_dict(self) -> dict:
        """The fields that differ from "everything"."""
        plain = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        return {k: v for k, v in plain.items() if v and v != ALL}


def refuse_unknown(values: dict, known: set[str], what: str) -> None:
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown keys in {what}: {', '.join(map(str, unknown))}")


LIST_FIELDS = tuple(f.name for f in fields(MedicineFilter) if f.name != "product_type")


def product_type_is(code: Column, product_type: str) -> Column:
    if product_type == ALL:
        return F.lit(True)
    generic = bnf.is_generic(code)
    return generic if product_type == GENERIC else ~generic


def code_predicate(query: MedicineFilter, code: Column) -> Column:
    """The part of a filter that only looks at the code itself."""
    wanted = bnf.matches_any(code, query.bnf_codes) if query.bnf_codes else F.lit(True)
    return wanted & ~bnf.matches_any(code, query.bnf_codes_excluded) & product_type_is(code, query.product_type)


def fits_forms_and_routes(descr: Column, forms: tuple[str, ...], routes: tuple[str, ...]) -> Column:
    """A form/route that starts with every given form and ends with every given route."""
    conditions = [descr.startswith(f"{form}.") for form in forms] + [descr.endswith(f".{route}") for route in routes]
    return reduce(and_, conditions)


def expand_forms_routes(form_routes: DataFrame, forms: tuple[str, ...], routes: tuple[str, ...]) -> DataFrame:
    """The catalogued form/routes that fit all given forms and routes; none when none are given."""
    fits = fits_forms_and_routes(F.col("descr"), forms, routes) if forms or routes else F.lit(False)
    return form_routes.where(fits).select("descr")


def _overlaps(name: str, values: tuple) -> Column:
    kind = "array<bigint>" if name in ID_FIELDS else "array<string>"
    return F.coalesce(F.arrays_overlap(F.array_compact(name), F.lit(list(values)).cast(kind)), F.lit(False))


def _form_route_condition(listed: tuple, forms: tuple, routes: tuple) -> Column:
    conditions = []
    if listed:
        conditions.append(_overlaps("form_routes", listed))
    if forms or routes:
        conditions.append(F.exists("form_routes", lambda descr: fits_forms_and_routes(descr, forms, routes)))
    return reduce(or_, conditions)


def _medication_conditions(query: MedicineFilter, suffix: str) -> dict[str, Column]:
    """Condition on medications per active field (form/routes, ingredients, moieties)."""

    def values(name):
        return getattr(query, name + suffix)

    conditions = {}
    if values("form_routes") or values("forms") or values("routes"):
        conditions["form_routes"] = _form_route_condition(values("form_routes"), values("forms"), values("routes"))
    if values("ingredient_ids"):
        conditions["ingredient_ids"] = _overlaps("ingredient_ids", values("ingredient_ids"))
    if values("vtm_ids"):
        conditions["vtm_ids"] = F.col("vtm_id").isin(*values("vtm_ids"))
    return {name + suffix: condition for name, condition in conditions.items()}


def _known_forms_and_routes(queries: dict[str, MedicineFilter], form_routes: DataFrame) -> dict[str, Column]:
    """Per filter with only forms and routes: whether any catalogued form/route fits them (one look for all)."""
    wanted = {n: q for n, q in queries.items() if (q.forms or q.routes) and not q.form_routes}
    if not wanted:
        return {}
    fits = [
        F.coalesce(F.bool_or(fits_forms_and_routes(F.col("descr"), q.forms, q.routes)), F.lit(False)).alias(n)
        for n, q in wanted.items()
    ]
    known = form_routes.agg(F.struct(*fits).alias("known")).scalar()
    return {n: known[n] for n in wanted}


def filter_flags(queries: dict[str, MedicineFilter], catalogue: Catalogue) -> DataFrame:
    """(code, name, *one flag per filter*): which filters select each catalogued presentation.

    What depends on medications is reduced to flags per code in one pass over them, whatever the number of
    filters; the rest are predicates on the code.
    """
    conditions = {n: _medication_conditions(q, "") | _medication_conditions(q, EXCLUDED) for n, q in queries.items()}
    flags = {f"{n}:{field}": condition for n, fields_ in conditions.items() for field, condition in fields_.items()}
    codes = catalogue.presentations().select("code", "name")
    if flags:
        held = (
            catalogue.medications.where(F.col("bnf_code").isNotNull())
            .groupBy(F.col("bnf_code").alias("code"))
            .agg(*(F.bool_or(condition).alias(key) for key, condition in flags.items()))
        )
        codes = codes.join(held, "code", "left")
    known = _known_forms_and_routes(queries, catalogue.form_routes)

    def selected(n: str, query: MedicineFilter) -> Column:
        result = code_predicate(query, F.col("code"))
        for field in conditions[n]:
            met = F.coalesce(F.col(f"`{n}:{field}`"), F.lit(False))
            if field.endswith(EXCLUDED):
                result &= ~met
            elif field == "form_routes" and n in known:
                # Forms and routes that fit no catalogued form/route leave the filter out instead of emptying it.
                result &= met | ~known[n]
            else:
                result &= met
        return result

    return codes.select("code", "name", *(selected(n, q).alias(n) for n, q in queries.items()))


def labelled_values(name: str, label: str, values: Column) -> Column:
    """An array as one of (name, value) with the label as the first field; a missing array is empty."""
    texts = F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))
    return F.transform(texts, lambda v: F.struct(F.lit(label).alias(name), v.alias("value")))


# Bits of the fields a code has to meet.
_BITS = {"bnf_codes": 1, "form_routes": 2, "ingredient_ids": 4, "vtm_ids": 8}


def filter_hits(queries: dict[str, MedicineFilter], catalogue: Catalogue) -> DataFrame:
    """(code, filter): the catalogued presentations that each of any number of filters selects.

    The filters are rows, not columns: a code meets them by its prefixes, a medication by its values, all by equi-joins
    with the small table of rules. What a code has met is a sum of bits, and an exclusion is a row, too. The plan is
    the same for one filter and for a thousand.
    """
    spark = catalogue.codes.sparkSession
    rules = [
        (n, _BITS[field], field, str(v), name.endswith(EXCLUDED))
        for n, q in queries.items() for name in LIST_FIELDS if (field := name.removesuffix(EXCLUDED)) in _BITS for v in getattr(q, name)
    ]
    halves = [
        (n, field, str(v), name.endswith(EXCLUDED), len(set(getattr(q, f"forms{suffix}"))) + len(set(getattr(q, f"routes{suffix}"))))
        for n, q in queries.items() for suffix in ("", EXCLUDED) for field in ("forms", "routes")
        for name in (field + suffix,) for v in sorted(set(getattr(q, name)))
    ]
    needs = []
    for n, q in queries.items():
        has_forms = bool(q.form_routes or q.forms or q.routes)
        need = sum(_BITS[f] for f in _BITS if (has_forms if f == "form_routes" else getattr(q, f)))
        needs.append((n, need, q.product_type, bool(q.forms or q.routes) and not q.form_routes))
    if not halves:  # then what a filter needs doesn't depend on the catalogue
        rules += [(n, 0, "bnf_codes", "", False) for n, need, _, _ in needs if need == 0]
    text, number, flag = pa.string(), pa.int32(), pa.bool_()
    rule = local_rows(spark, rules, filter=text, bit=number, kind=text, value=text, excluded=flag)
    filters = local_rows(spark, needs, filter=text, need=number, product_type=text, by_parts=flag)

    presentations = catalogue.presentations().select("code")
    # The keys of a code that rules can have: its prefixes of their lengths, and its strength code.
    codes = [value for _, _, kind, value, _ in rules if kind == "bnf_codes"]
    lengths = sorted({len(c) for c in codes if "_" not in c} | {0})
    own = [F.when(F.length("code") >= n, F.substring("code", 1, n)) for n in lengths]
    own += [F.when(F.length("code") >= 9, bnf.strength_code(F.col("code")))] if any("_" in c for c in codes) else []
    keys = presentations.select("code", F.lit("bnf_codes").alias("kind"), F.explode(F.array_compact(F.array(*own))).alias("value"))
    held = F.concat(*(
        labelled_values("kind", field, values)
        for field, values in (("form_routes", F.col("form_routes")), ("ingredient_ids", F.col("ingredient_ids")), ("vtm_ids", F.array("vtm_id")))
    ))
    medication = catalogue.medications.where(F.col("bnf_code").isNotNull()).select(F.col("bnf_code").alias("code"), F.explode(held).alias("x")).select("code", "x.*")

    if not halves:
        values = keys.unionByName(medication) if any(kind != "bnf_codes" for _, _, kind, _, _ in rules) else keys
        hits = values.join(F.broadcast(rule), ["kind", "value"]).select("code", "filter", "bit", "excluded")
        return _selected(hits, filters.drop("by_parts"), presentations)

    # Form/routes that begin with every form and end with every route a filter gives: few, whatever the filters.
    known = catalogue.form_routes.select(F.col("descr").alias("value")).distinct()
    used = medication.where(F.col("kind") == "form_routes").select("value").distinct().unionByName(known).distinct()
    words = F.split("value", r"\.")
    cuts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    cut = used.select(F.col("value").alias("descr"), F.explode(F.flatten(F.transform(cuts, lambda i: F.array(
        F.struct(F.lit("forms").alias("kind"), F.array_join(F.slice(words, F.lit(1), i), ".").alias("value")),
        F.struct(F.lit("routes").alias("kind"), F.array_join(F.slice(words, i + 1, F.size(words)), ".").alias("value")),
    )))).alias("x")).select("descr", "x.*").distinct()
    half = local_rows(spark, halves, filter=text, kind=text, value=text, excluded=flag, wanted=number)
    fits = cut.join(F.broadcast(half), ["kind", "value"]).groupBy("descr", "filter", "excluded").agg(F.count(F.lit(1)).alias("met"), F.max("wanted").alias("wanted"))
    fits = fits.where(F.col("met") == F.col("wanted")).select(F.col("descr").alias("value"), "filter", "excluded")
    by_parts = medication.where(F.col("kind") == "form_routes").join(fits, "value").select("code", "filter", F.lit(_BITS["form_routes"]).alias("bit"), "excluded")

    # Forms and routes that fit no catalogued form/route leave the filter out; a filter of nothing selects every code.
    some = fits.where(~F.col("excluded")).join(known, "value", "left_semi").select("filter").distinct().withColumn("is_known", F.lit(True))
    need = F.col("need") - F.when(F.col("by_parts") & F.col("is_known").isNull(), _BITS["form_routes"]).otherwise(0)
    filters = filters.join(some, "filter", "left").select("filter", need.alias("need"), "product_type")
    every = filters.where(F.col("need") == 0).select("filter", F.lit(0).alias("bit"), F.lit("bnf_codes").alias("kind"), F.lit("").alias("value"), F.lit(False).alias("excluded"))

    rule = rule.unionByName(every)
    hits = keys.unionByName(medication).join(F.broadcast(rule), ["kind", "value"]).select("code", "filter", "bit", "excluded").unionByName(by_parts)
    return _selected(hits, filters, presentations)


def _selected(hits: DataFrame, filters: DataFrame, presentations: DataFrame) -> DataFrame:
    """(code, filter) of the codes that meet what a filter needs and nothing it excludes."""
    met = hits.groupBy("code", "filter").agg(F.bit_or(F.when(F.col("excluded"), 0).otherwise(F.col("bit"))).alias("met"), F.bool_or("excluded").alias("out"), F.bool_or(~F.col("excluded")).alias("there"))
    generic = bnf.is_generic(F.col("code"))
    of_type = (F.col("product_type") == ALL) | F.when(F.col("product_type") == GENERIC, generic).otherwise(~generic)
    selected = met.join(F.broadcast(filters), "filter").where(F.col("there") & ~F.col("out") & (F.col("met").bitwiseAND(F.col("need")) == F.col("need")) & of_type)
    return selected.join(presentations, "code", "left_semi").select("code", "filter")


def matching_codes(query: MedicineFilter, catalogue: Catalogue) -> DataFrame:
    """(code): the catalogued presentations a filter selects. Sort by code where the order is shown."""
    return filter_flags({"selected": query}, catalogue).where("selected").select("code")


def prescribing_items(prescribing: DataFrame, codes: DataFrame, value: str = "items") -> DataFrame:
    """(bnf_code, practice_code, date, value) of the prescribing of the given codes."""
    wanted = codes.select(F.col("code").alias("bnf_code"))
    return prescribing.join(wanted, "bnf_code", "left_semi").select("bnf_code", "practice_code", "date", F.col(value).alias("value"))


def list_size_items(list_size: DataFrame) -> DataFrame:
    """(practice_code, date, value) with registered patients as the value."""
    return list_size.select("practice_code", "date", F.col("total").alias("value"))


def field_values(spark: SparkSession, query: MedicineFilter) -> DataFrame:
    """(field, position, value) for every value of a filter, as text."""
    rows = [(name, i, str(v)) for name in LIST_FIELDS for i, v in enumerate(getattr(query, name))]
    return spark.createDataFrame(rows, "field string, position int, value string")


def _valid_values(catalogue: Catalogue) -> DataFrame:
    """(kind, value): every value that means something in a field of that kind."""
    empty = F.lit(None).cast("string")
    descr = catalogue.form_routes.select("descr", F.split("descr", r"\.", 2).alias("halves"))
    codes = catalogue.presentations().select(F.lit("bnf_codes").alias("kind"), F.explode(bnf.match_keys(F.col("code"))).alias("value"))
    kinds = [
        descr.select(F.lit("form_routes").alias("kind"), F.col("descr").alias("value")),
        descr.select(F.lit("forms").alias("kind"), F.col("halves")[0].alias("value")),
        descr.select(F.lit("routes").alias("kind"), F.when(F.size("halves") > 1, F.col("halves")[1]).otherwise(empty).alias("value")),
        catalogue.ingredients.select(F.lit("ingredient_ids").alias("kind"), F.col("isid").cast("string").alias("value")),
        catalogue.vtms.select(F.lit("vtm_ids").alias("kind"), F.col("vtmid").cast("string").alias("value")),
    ]
    return reduce(DataFrame.unionByName, kinds, codes)


def query_validate(query: MedicineFilter | dict, catalogue: Catalogue) -> DataFrame:
    """(field, value) of every value that matches nothing; malformed strength codes match nothing either.

    Of a dictionary, a product type that does not exist is listed, too.
    """
    spark = catalogue.codes.sparkSession
    wrong = []
    if isinstance(query, dict):
        product_type = query.get("product_type", ALL)
        if product_type not in PRODUCT_TYPES:
            wrong = [("product_type", str(product_type))]
            query = {k: v for k, v in query.items() if k != "product_type"}
        query = MedicineFilter.from_dict(query)
    given = field_values(spark, query).withColumn("kind", F.regexp_replace("field", f"{EXCLUDED}$", ""))
    # The catalogue streams past the few values of the filter; what is met of them is as small as they are.
    met = _valid_values(catalogue).join(F.broadcast(given.select("kind", "value")), ["kind", "value"], "left_semi").distinct()
    unmatched = given.join(F.broadcast(met), ["kind", "value"], "left_anti").select("field", "value")
    return unmatched.unionByName(spark.createDataFrame(wrong, "field string, value string")) if wrong else unmatched


def query_describe(query: MedicineFilter, catalogue: Catalogue) -> DataFrame:
    """(field, position, value, description) with names in place of codes and ids; unknown ones fail."""
    given = field_values(catalogue.codes.sparkSession, query).withColumn("kind", F.regexp_replace("field", f"{EXCLUDED}$", ""))
    is_strength = (F.col("kind") == "bnf_codes") & F.col("value").contains("_")
    halves = F.split("value", "_", 2)
    generic = F.concat(halves[0], F.lit(bnf.GENERIC_PRODUCT), halves[1], halves[1])
    wanted = given.withColumn("looked_up", F.when(is_strength, generic).otherwise(F.col("value"))).withColumn("is_strength", is_strength)
    names = (
        catalogue.codes.select(F.lit("bnf_codes").alias("kind"), F.col("code").alias("looked_up"), "name")
        .unionByName(catalogue.ingredients.select(F.lit("ingredient_ids").alias("kind"), F.col("isid").cast("string").alias("looked_up"), F.col("nm").alias("name")))
        .unionByName(catalogue.vtms.select(F.lit("vtm_ids").alias("kind"), F.col("vtmid").cast("string").alias("looked_up"), F.col("nm").alias("name")))
    )
    unknown = F.raise_error(F.concat(F.lit("Unknown value in "), F.col("field"), F.lit(": "), F.col("value"))).cast("string")
    known = F.when(F.col("kind").isin("form_routes", "forms", "routes"), F.col("value")).otherwise(F.coalesce("name", unknown))
    both = F.lit(" (branded and generic)" if query.product_type == ALL else "")
    return wanted.join(names, ["kind", "looked_up"], "left").select(
        "field", "position", "value", F.when(F.col("is_strength"), F.concat(known, both)).otherwise(known).alias("description")
    )
