"""Faithful Parquet copies of downloaded CSV and JSON files, read in parallel whatever their layout."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.session import new_path, written
from scriptline.sources.blocks import count_before, pieces, state_before

# A quote begins a quoted field only at the start of one. Inside, two quotes stand for one.
_QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
_OPENED = r'(^|,)"'
_REST_OF_QUOTED = r'^[^"]*+(?:""[^"]*+)*+"'


def read_csv_strings(spark: SparkSession, path: str, encoding: str = "UTF-8", skip: int = 0, multi_line: bool = False) -> DataFrame:
    """CSV files with a header as strings, without guessing types; ``skip`` lines of each file precede its header.

    A row that does not fit the header fails, and so do files with different headers. ``multi_line`` allows line breaks
    in quotes. Behind a preamble, or with line breaks in quotes, files are cut into blocks, and what a block starts in
    is known from the blocks before it.
    """
    if skip == 0 and not multi_line:
        return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, mode="FAILFAST", escape='"')
    records = _records(spark, path, encoding, skip)
    heads = records.where(F.col("record") == 0).select("text").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"no header in {path}" if not heads else f"files of {path} have different headers")
    names = next(csv.reader([heads[0].text]))
    options = {"mode": "FAILFAST", "escape": '"'}
    return records.where(F.col("record") > 0).select(F.from_csv("text", _strings_ddl(names), options).alias("row")).select("row.*")


def _records(spark: SparkSession, path: str, encoding: str, skip: int) -> DataFrame:
    """(file, record, text) of all records behind the preambles, numbered from 0 in each file; blank ones don't count."""
    lines = written(pieces(spark, path, "\n", encoding).select("*", *_quote_states(F.col("text"))), "csv_lines")
    behind = count_before(lines, F.lit(1), "line").where(F.col("line") >= skip).drop("line") if skip else lines
    placed = state_before(behind, "quoted").where((F.col("quoted") == 1) | (F.trim(F.regexp_replace("text", "\r$", "")) != ""))
    begins = (F.col("quoted") == 0).cast("int")
    numbered = count_before(placed, begins, "record").withColumn("record", F.col("record") + begins - 1)
    whole = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "text"))).alias("lines"))
    return whole.select("file", "record", F.regexp_replace(F.array_join("lines.text", "\n"), "\r$", "").alias("text"))


def _quote_states(line: Column) -> list[Column]:
    """Whether a quoted field is open (1) after the line, when none was before it (from_0), or one was (from_1)."""

    def open_after(rest: Column) -> Column:
        return F.regexp_replace(rest, _QUOTED, "$1").rlike(_OPENED).cast("int")

    # What follows a closing quote is no start of a field, so the rest begins with something else.
    closed = F.regexp_replace(line, _REST_OF_QUOTED, "x")
    inside = F.when(line.rlike(_REST_OF_QUOTED), open_after(closed)).otherwise(1)
    plain = ~line.contains('"')
    return [F.when(plain, 0).otherwise(open_after(line)).alias("from_0"), F.when(plain, 1).otherwise(inside).alias("from_1")]


def _strings_ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)


def csv_archive(spark: SparkSession, source: str, target: str, encoding: str = "UTF-8", skip: int = 0, multi_line: bool = False) -> None:
    """CSV -> Parquet with string columns, compressed with zstd."""
    read_csv_strings(spark, source, encoding, skip, multi_line).write.option("compression", "zstd").parquet(target)


def json_archive(spark: SparkSession, source: str, target: str, whole_file: bool = True) -> None:
    """JSON array (or one object or array per line) -> Parquet; types come from the whole input."""
    lines = json_elements(spark, source) if whole_file else source
    rows = spark.read.option("samplingRatio", 1.0).json(lines)
    rows.write.option("compression", "zstd").parquet(target)


def json_elements(spark: SparkSession, path: str) -> str:
    """Write the objects of array files, or files of one object after another, one per line; returns the new path.

    A file is cut at every closing brace and read in blocks. Braces in strings are told apart by the quotes before
    them, the end of an element by the depth of brackets. An array of anything but objects fails.
    """
    text = F.col("text")
    bare = F.regexp_replace(text, r"\\.", "")  # no escaped quotes
    parts = F.split(bare, '"')

    def brackets(outside: int) -> Column:
        kept = F.array_join(F.filter(parts, lambda _, i: i % 2 == outside), "")
        return F.length(F.regexp_replace(kept, r"[^\[{]", "")) - F.length(F.regexp_replace(kept, r"[^\]}]", ""))

    odd = ((F.size(parts) - 1) % 2).cast("int")
    cut = pieces(spark, path, "}").select("*", odd.alias("from_0"), (1 - odd).alias("from_1"), brackets(0).alias("depth_0"), brackets(1).alias("depth_1"))
    cut = written(cut, "json_pieces")
    first = F.regexp_replace(F.min_by("text", F.struct("block", "at")), "^[﻿\\s]+", "")
    files = cut.groupBy("file").agg(first.startswith("[").cast("int").alias("base"), F.max(F.struct("block", "at")).alias("last"))
    stated = state_before(cut, "quoted").join(cut.select("file", "block", "at", F.col("from_0").alias("odd")), ["file", "block", "at"])
    plain_after = F.pmod(F.col("quoted") + F.col("odd"), F.lit(2)) == 0
    own = F.when(F.col("quoted") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    stated = written(stated.select("file", "block", "at", "text", own.alias("own"), plain_after.alias("plain")), "json_states")
    # Every piece but the last one of a file is followed by the brace it was cut at.
    deep = count_before(stated, F.col("own") - F.col("plain").cast("int"), "depth").join(files, "file")
    is_last = F.struct("block", "at") == F.col("last")
    braced = ~is_last | (F.col("depth") + F.col("own") > 0)
    ends = F.col("plain") & braced & (F.col("depth") + F.col("own") - 1 == F.col("base"))
    numbered = count_before(deep.select("file", "block", "at", "text", "base", braced.alias("braced"), ends.alias("ends")), F.col("ends").cast("int"), "element")
    pieced = F.when(F.col("braced"), F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    whole = numbered.groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", pieced.alias("text")))).alias("parts"), F.max("ends").alias("whole")
    )
    value = F.regexp_replace(F.regexp_replace(F.array_join("parts.text", ""), r"[\r\n]+", " "), "^[﻿\\s]*[\\[,]?\\s*", "")
    odd_one = F.raise_error(F.concat(F.lit("not an object of a JSON array: "), F.left(value, F.lit(80)))).cast("string")
    checked = F.when(F.col("whole") & value.startswith("{"), value).when(~F.col("whole") & value.rlike(r"^\]?\s*$"), F.lit("")).otherwise(odd_one)
    target = new_path(spark, "json_elements")
    whole.select(checked.alias("value")).where(F.col("value") != "").write.text(target)
    return target
