"""Medicine dictionary: XML entity groups as tables, and their typed load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptline.session import new_path
from scriptline.sources import items
from scriptline.sources.blocks import pieces

# Per XML file the item tags with their fields, in file order.
ENTITIES = {
    "ampp": {
        "AMPP": ("APPID", "INVALID", "NM", "ABBREVNM", "VPPID", "APID", "COMBPACKCD", "LEGAL_CATCD", "SUBP", "DISCCD", "DISCDT"),
        "PACK_INFO": ("APPID", "REIMB_STATCD", "REIMB_STATDT", "REIMB_STATPREVCD", "PACK_ORDER_NO"),
        "PRESCRIB_INFO": ("APPID", "SCHED_2", "ACBS", "PADM", "FP10_MDA", "SCHED_1", "HOSP", "NURSE_F", "ENURSE_F", "DENT_F"),
        "PRICE_INFO": ("APPID", "PRICE", "PRICEDT", "PRICE_PREV", "PRICE_BASISCD"),
        "REIMB_INFO": ("APPID", "PX_CHRGS", "DISP_FEES", "BB", "LTD_STAB", "CAL_PACK", "SPEC_CONTCD", "DND", "FP34D"),
        "CCONTENT": ("PRNTAPPID", "CHLDAPPID"),
    },
    "amp": {
        "AMP": ("APID", "INVALID", "VPID", "NM", "ABBREVNM", "DESC", "NMDT", "NM_PREV", "SUPPCD", "LIC_AUTHCD", "LIC_AUTH_PREVCD", "LIC_AUTHCHANGECD", "LIC_AUTHCHANGEDT", "COMBPRODCD", "FLAVOURCD", "EMA", "PARALLEL_IMPORT", "AVAIL_RESTRICTCD"),
        "AP_ING": ("APID", "ISID", "STRNTH", "UOMCD"),
        "LIC_ROUTE": ("APID", "ROUTECD"),
        "AP_INFO": ("APID", "SZ_WEIGHT", "COLOURCD", "PROD_ORDER_NO"),
    },
    "ingredient": {
        "ING": ("ISID", "ISIDDT", "ISIDPREV", "INVALID", "NM"),
    },
    "vmpp": {
        "VMPP": ("VPPID", "INVALID", "NM", "ABBREVNM", "VPID", "QTYVAL", "QTY_UOMCD", "COMBPACKCD"),
        "DTINFO": ("VPPID", "PAY_CATCD", "PRICE", "DT", "PREVPRICE"),
        "CCONTENT": ("PRNTVPPID", "CHLDVPPID"),
    },
    "vmp": {
        "VMP": ("VPID", "VPIDDT", "VPIDPREV", "VTMID", "INVALID", "NM", "ABBREVNM", "BASISCD", "NMDT", "NMPREV", "BASIS_PREVCD", "NMCHANGECD", "COMBPRODCD", "PRES_STATCD", "SUG_F", "GLU_F", "PRES_F", "CFC_F", "NON_AVAILCD", "NON_AVAILDT", "DF_INDCD", "UDFS", "UDFS_UOMCD", "UNIT_DOSE_UOMCD"),
        "VPI": ("VPID", "ISID", "BASIS_STRNTCD", "BS_SUBID", "STRNT_NMRTR_VAL", "STRNT_NMRTR_UOMCD", "STRNT_DNMTR_VAL", "STRNT_DNMTR_UOMCD"),
        "ONT": ("VPID", "FORMCD"),
        "DFORM": ("VPID", "FORMCD"),
        "DROUTE": ("VPID", "ROUTECD"),
        "CONTROL_INFO": ("VPID", "CATCD", "CATDT", "CAT_PREVCD"),
    },
    "vtm": {
        "VTM": ("VTMID", "INVALID", "NM", "ABBREVNM", "VTMIDPREV", "VTMIDDT"),
    },
}

# Groups of the look-up file (items have CD and DESC), and those with more fields.
LOOKUP_GROUPS = ("COMBINATION_PACK_IND", "COMBINATION_PROD_IND", "BASIS_OF_NAME", "NAMECHANGE_REASON", "VIRTUAL_PRODUCT_PRES_STATUS", "CONTROL_DRUG_CATEGORY", "LICENSING_AUTHORITY", "UNIT_OF_MEASURE", "FORM", "ONT_FORM_ROUTE", "ROUTE", "DT_PAYMENT_CATEGORY", "SUPPLIER", "FLAVOUR", "COLOUR", "BASIS_OF_STRNTH", "REIMBURSEMENT_STATUS", "SPEC_CONT", "DND", "VIRTUAL_PRODUCT_NON_AVAIL", "DISCONTINUED_IND", "DF_INDICATOR", "PRICE_BASIS", "LEGAL_CATEGORY", "AVAILABILITY_RESTRICTION", "LICENSING_AUTHORITY_CHANGE_REASON")
_LOOKUP_ITEM = "INFO"
DATED_LOOKUPS = ("UNIT_OF_MEASURE", "FORM", "ROUTE", "SUPPLIER")

# Fields whose type does not follow from the ending of their name.
BOOLEANS = ("INVALID", "SCHED_1", "SCHED_2", "ACBS", "PADM", "FP10_MDA", "HOSP", "NURSE_F", "ENURSE_F", "DENT_F", "BB", "CAL_PACK", "FP34D", "EMA", "PARALLEL_IMPORT", "SUG_F", "GLU_F", "PRES_F", "CFC_F")
INTEGERS = ("PRICE", "PRICE_PREV", "PREVPRICE", "PX_CHRGS", "DISP_FEES", "DND")
DECIMALS = {
    "QTYVAL": T.DecimalType(10, 2),
    "UDFS": T.DecimalType(10, 3),
    "STRNT_NMRTR_VAL": T.DecimalType(10, 3),
    "STRNT_DNMTR_VAL": T.DecimalType(10, 3),
}
RENAMED = {"desc": "descr", "dnd": "dndcd"}
ALWAYS_MISSING = "ltd_stab"


def lookup_fields(group: str) -> list[str]:
    dated = ["CDDT", "CDPREV"] if group in DATED_LOOKUPS else []
    return ["CD", *dated, *(["INVALID"] if group == "SUPPLIER" else []), "DESC"]


def table_fields(file_id: str) -> dict[str, tuple[str, ...]]:
    """The groups of a file and their fields; in the look-up file a group holds items of one tag."""
    return {g: tuple(lookup_fields(g)) for g in LOOKUP_GROUPS} if file_id == "lookup" else ENTITIES[file_id]


def xml_items(spark: SparkSession, path: str, file_id: str) -> DataFrame:
    """(group, texts): every item of every group of an XML file, in one pass; texts are in the order of its group's fields.

    A file is cut at every "<" and read in blocks. An item is the opening tags from its own up to the next item's,
    counted from the start of the file, so it may lie in two blocks. Of a field that is there twice the last counts. A
    task puts the items of its blocks together while it reads them, and the items are written by group. Only what a
    block cannot know alone, mostly a few rows each, is looked at again.
    """
    groups, item = table_fields(file_id), _LOOKUP_ITEM if file_id == "lookup" else None
    target = new_path(spark, f"xml_items_{file_id}")
    tags = _tags(pieces(spark, path, "<"), (*groups, *items.all_fields(groups), _LOOKUP_ITEM))
    tags.mapInArrow(items.assembled(groups, item), items.SCHEMA).write.partitionBy("group").parquet(target)
    parts = spark.read.schema(items.SCHEMA).parquet(target).where(F.col("group").isNull()).drop("group")
    _joined_parts(parts, groups, item).write.mode("append").partitionBy("group").parquet(target)
    return spark.read.schema("texts array<string>, group string").parquet(target).where(F.col("group").isNotNull())


def _tags(cut: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(file, block, tag, value): opening tags and the texts behind them, in the order of the pieces."""
    piece = F.col("text")
    comment = piece.startswith("!--")
    trailing = F.regexp_replace(F.regexp_replace(piece, "(?s)^!--.*?-->", ""), r"\s+", "") != ""
    unknown = F.when(comment & (~piece.contains("-->") | trailing), "a comment with a tag, or in a text").when(piece.startswith("![CDATA["), "a CDATA section")
    opens = ~F.substring(piece, 1, 1).isin("/", "!", "?", "")
    opened = cut.where(F.when(unknown.isNotNull(), F.raise_error(F.concat(F.lit("cannot read "), unknown)).cast("boolean")).otherwise(opens))
    # No tag's name is as long as a name with blanks, so the first piece of a file, if it is no tag, has none.
    form = r"(?s)^([A-Za-z_][\w.:-]*)(?:\s[^>]*)?>(.*)$"
    headed = opened.select("file", "block", "text", F.substring_index(piece, ">", 1).alias("head")).where(~F.col("head").isin(*(f"{n}/" for n in known)))
    # Known names without attributes, which are most, need no pattern.
    plain = F.col("head").isin(*known) & (F.octet_length("head") < F.octet_length(piece))
    behind = piece.substr(F.octet_length("head") + 2, F.octet_length(piece))
    named = headed.select("file", "block", F.when(plain, F.col("head")).otherwise(F.regexp_extract(piece, form, 1)).alias("tag"), F.when(plain, behind).otherwise(F.regexp_extract(piece, form, 2)).alias("value"))
    return _plain(named, "value")


def _joined_parts(parts: DataFrame, groups: dict[str, tuple[str, ...]], item: str | None) -> DataFrame:
    """Items that lie in several blocks, and items whose group was opened in an earlier block."""
    kind, fields = F.col("part"), items.all_fields(groups)
    if item:
        ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.where(kind == items.END).select("file", "block", F.last("opened", ignorenulls=True).over(ahead).alias("before"))
        parts = parts.where(kind != items.END).join(before, ["file", "block"]).withColumn("opened", F.coalesce("opened", "before"))
    begins = (kind == items.TAIL).cast("int")
    until = Window.partitionBy("file").orderBy("block", begins).rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.where(kind.isin(items.HEAD, items.TAIL)).withColumn("item", F.sum(begins).over(until)).where("item > 0")
    place, text = F.struct("block", begins.alias("begins")), [F.col("texts")[i] for i in range(len(fields))]
    last = F.array(*(F.nullif(F.max_by(t, F.when(t.isNotNull(), place)), F.lit("")) for t in text))
    found = numbered.groupBy("file", "item").agg(last.alias("texts"), F.max_by("opened", begins).alias("group")).select("texts", "group")
    if item:
        found = found.unionByName(parts.where(kind == items.NO_GROUP).select("texts", F.col("opened").alias("group")))
    texts = F.coalesce(*(F.when(F.col("group") == g, F.array(*(text[fields.index(f)] for f in own))) for g, own in groups.items()))
    return found.select(texts.alias("texts"), "group").where(F.col("group").isNotNull())


# Characters and references that a parser changes or refuses.
_NOT_PLAIN, _OTHER_REFERENCE = r"[^\t\n -~]", "&(?!(?:amp|lt|gt|quot|apos);)"


def _plain(rows: DataFrame, name: str) -> DataFrame:
    """The texts of a column without white space around them and with their entities resolved; an empty one is missing.

    A parser for each text takes far longer than all the rest, so only an unusual text gets one. It is done in steps,
    since what is named twice within one is worked out twice.
    """
    text, simple = F.col(name), F.col("_simple")
    replaced = text
    for entity, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):  # what the last one leaves is no entity
        replaced = F.replace(replaced, F.lit(f"&{entity};"), F.lit(sign))
    to_parse = text.rlike(_NOT_PLAIN) | text.contains("]]>") | text.rlike(_OTHER_REFERENCE)
    ascii_only = F.octet_length(text) == F.char_length(text)
    rows = rows.withColumn("_simple", F.when(text.contains("&"), F.when(~to_parse, replaced)).when(ascii_only, text))
    parsed = F.when(text.contains("&"), F.xpath_string(F.concat(F.lit("<x>"), text, F.lit("</x>")), F.lit("/x"))).otherwise(text)
    trimmed = F.when(simple.isNotNull(), F.btrim(simple, F.lit(" \t\n\x0b\f\r"))).otherwise(F.regexp_replace(parsed, r"^\s+|\s+$", ""))
    return rows.withColumn(name, trimmed).withColumn(name, F.when(text != "", text)).drop("_simple")


def xml_table(rows: DataFrame, file_id: str, group: str) -> DataFrame:
    """One group of a file's items as text columns with lower-case names."""
    fields = table_fields(file_id)[group]
    return rows.where(F.col("group") == group).select(*(F.col("texts")[i].alias(f.lower()) for i, f in enumerate(fields)))


def xml_entities(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """All groups of the given XML files by table name (file and group, as one tag occurs in two files)."""
    tables = {}
    for file_id, path in paths.items():
        rows = xml_items(spark, path, file_id)
        tables |= {f"{file_id}_{group.lower()}": xml_table(rows, file_id, group) for group in table_fields(file_id)}
    return tables


def field_type(name: str) -> T.DataType:
    """Type of a dictionary field: by list, else by the ending of its name (ids, codes, dates), else text."""
    field = name.upper()
    if field in BOOLEANS:
        return T.BooleanType()
    if field in INTEGERS:
        return T.IntegerType()
    if field in DECIMALS:
        return DECIMALS[field]
    if field.endswith("DT"):
        return T.DateType()
    if field.endswith(("ID", "CD", "IDPREV", "CDPREV")):
        return T.LongType()
    return T.StringType()


def load_dmd(entity: DataFrame) -> DataFrame:
    """Typed columns; names that clash with SQL words are changed. A flag is true where it has any text.

    One column is expected to be always missing and is dropped; a value in it fails.
    """
    if ALWAYS_MISSING in entity.columns:
        unexpected = F.raise_error(F.lit(f"Unexpected value in {ALWAYS_MISSING}")).cast("boolean")
        entity = entity.where(F.when(F.col(ALWAYS_MISSING).isNull(), True).otherwise(unexpected)).drop(ALWAYS_MISSING)
    return entity.select(*(_typed(c).alias(RENAMED.get(c, c)) for c in entity.columns))


def _typed(name: str) -> Column:
    kind, column = field_type(name), F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column != "", F.lit(False))
    return column.cast(kind)
