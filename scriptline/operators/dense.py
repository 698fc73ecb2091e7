"""Long-form "matrix" primitives: (row label, month, value) frames that can be made dense with zeros.

A month list grows by twelve a year, so it travels as one array from a scalar subquery: no cross join, no join at
all. Zero cells are added as extra rows and disappear into the sum that is computed anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptline.session import checked_broadcast

CENTILES = (10, 20, 30, 40, 50, 60, 70, 80, 90)

# Values of a group that are counted in the memory of one task, some megabytes, if there are known to be no more.
COUNTED_ROWS = 50_000

# Accuracy of the sketch of a group's values: it knows ranks to one in so many rows.
SKETCH_ACCURACY = 10_000

# (least rows, half the width of a bracket around a centile as a share of the rows). A bracket spans at least six ranks
# to each side, and at least six times the sketch's error; groups with fewer rows are one bracket.
BRACKETS = ((10_000, 6e-4), (1_000, 6e-3), (100, 6e-2))


def recent_dates(dates: DataFrame, date_count: int | None = None) -> DataFrame:
    """The ``date_count`` most recent months (all when None)."""
    months = dates.select("date")
    return months if date_count is None else months.orderBy(F.col("date").desc()).limit(date_count)


def month_array(months: DataFrame) -> Column:
    """All months as one array value."""
    return months.agg(F.sort_array(F.collect_set("date")).alias("months")).scalar()


def active_practices(practices: DataFrame, months: DataFrame) -> DataFrame:
    """Practices that still prescribed in or after the oldest of the given months."""
    return practices.where(F.col("latest_prescribing_date") >= F.array_min(month_array(months)))


def zero_cells(rows: DataFrame, months: DataFrame) -> DataFrame:
    """One row per (row of ``rows``, month)."""
    return rows.withColumn("_months", month_array(months)).select(
        *rows.columns, F.explode("_months").alias("date")
    )


def accumulator_type(df: DataFrame, value: str) -> T.DataType:
    """Integers are summed as integers, other numbers as doubles; anything else is refused."""
    found = df.schema[value].dataType
    if isinstance(found, T.IntegralType):
        return T.LongType()
    if isinstance(found, T.NumericType):
        return T.DoubleType()
    raise TypeError(f"cannot sum {value}: {found.simpleString()}")


# Sums of doubles are made of three integers each: multiples of 2**12, of 2**-14, and of 2**-40 in what is left. The last
# two have 26 bits, so a long holds the sum of 10**11 of them.
_COARSE, _FINE, _FINEST = 2.0**12, 2.0**-14, 2.0**-40


def exact_sum(value: Column, kind: T.DataType) -> Column:
    """Sum of a column in its accumulator type (see ``accumulator_type``), whatever the order of the rows.

    A double's parts are taken without error, and integers are added up, so the result depends on the values alone:
    it has the same bits for every partitioning. Bits below 2**-40 are cut off; sums beyond 2**74 overflow, which fails.
    NaN and infinities give what they give in plain sums.
    """
    value = value.cast(kind)
    if not isinstance(kind, T.DoubleType):
        return F.sum(value)
    finite = F.abs(value) < float("inf")  # not NaN, the greatest value
    number = F.when(finite, value)
    coarse = F.floor(number / _COARSE)
    rest = number - coarse.cast("double") * _COARSE
    fine = F.floor(rest / _FINE)
    finest = F.floor((rest - fine.cast("double") * _FINE) / _FINEST)
    parts = ((coarse, _COARSE), (fine, _FINE), (finest, _FINEST))
    total = sum((F.sum(part).cast("double") * unit for part, unit in reversed(parts[:-1])), F.sum(finest).cast("double") * _FINEST)
    return F.coalesce(F.sum(F.when(~finite, value)), total)


def grouped_sum(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sum of each value per key (partial sums before the shuffle, so a hot key is no hot task)."""
    return df.groupBy(*keys).agg(*(exact_sum(F.col(v), accumulator_type(df, v)).alias(v) for v in values))


def filled_sum(cells: DataFrame, facts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums per cell of the grid, 0 where there is no fact; facts outside the grid are dropped."""
    types = {v: accumulator_type(facts, v) for v in values}
    grid = cells.select(*keys, *(F.lit(0).cast(types[v]).alias(v) for v in values), F.lit(True).alias("_cell"))
    rows = facts.select(*keys, *(F.col(v).cast(types[v]).alias(v) for v in values), F.lit(False).alias("_cell"))
    return (
        grid.unionByName(rows)
        .groupBy(*keys)
        .agg(*(F.coalesce(exact_sum(F.col(v), types[v]), F.lit(0).cast(types[v])).alias(v) for v in values), F.max("_cell").alias("_cell"))
        .where("_cell")
        .drop("_cell")
    )


def group_rows(matrix: DataFrame, row: str, members: DataFrame, group: str, months: DataFrame) -> DataFrame:
    """Add up rows into labelled groups.

    ``members`` is (group, row); a group with row NULL has no members and gives zeros, members missing from the
    matrix count as zeros, and a row in two groups is an error.
    """
    placed = matrix.join(single_group(members, row, group), row)
    groups = members.select(group).distinct()
    return filled_sum(zero_cells(groups, months), placed, [group, "date"], ["value"])


def single_group(members: DataFrame, row: str, group: str) -> DataFrame:
    """(row, group) with each row once; fails when a row is in two groups."""
    clash = F.raise_error(F.concat(F.lit("Single input row mapped to multiple output groups: "), F.col(row).cast("string")))
    return (
        members.where(F.col(row).isNotNull())
        .groupBy(row)
        .agg(F.max(group).alias("_group"), F.count(F.lit(1)).alias("_n"))
        .select(row, F.when(F.col("_n") == 1, F.col("_group")).otherwise(clash.cast("string")).alias(group))
    )


def scale(matrix: DataFrame, by: float) -> DataFrame:
    return matrix.withColumn("value", F.col("value") * F.lit(by))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is missing (NULL, never NaN) for a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def divide(numerator: DataFrame, denominator: DataFrame, row: str) -> DataFrame:
    """Element-wise division of two matrices with the same labels."""
    below = denominator.select(row, "date", F.col("value").alias("_below"))
    return numerator.join(below, [row, "date"]).withColumn("value", ratio(F.col("value"), F.col("_below"))).drop("_below")


def matrix_row(matrix: DataFrame, row: str, label: str) -> DataFrame:
    return matrix.where(F.col(row) == label)


def records(matrix: DataFrame, row: str, row_name: str, col_name: str, value_name: str = "value") -> DataFrame:
    return matrix.select(F.col(row).alias(row_name), F.col("date").alias(col_name), F.col("value").alias(value_name))


def missing_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def drop_zero_rows(matrix: DataFrame, row: str) -> DataFrame:
    """Drop rows that are 0 in every month (a missing value counts as non-zero)."""
    kept = matrix.where(F.col("value").isNull() | (F.col("value") != 0)).select(row).distinct()
    return matrix.join(kept, row, "left_semi")


def centiles(matrix: DataFrame, by: tuple[str, ...] = ("date",), groups: int | None = None, rows: int | None = None) -> DataFrame:
    """(centile, *by, value): p10 .. p90 per month, linear interpolation, missing values ignored.

    Exact at any size, by refinement: one pass makes a mergeable sketch of each group's ranks, which gives two values
    around each centile. Values below a bracket are only counted, those above left out; of each group some
    thousandths of the rows are inside a bracket and sorted, equal ones as one. Brackets go by rank, so an outlier
    changes none. ``groups`` is an upper bound of the number of groups where it is known: brackets are broadcast then.
    ``rows`` is one of the rows in a group: where so few values are known to fit in a task, one pass is enough.
    """
    by = list(by)
    if rows is not None and rows <= COUNTED_ROWS:
        exact = matrix.groupBy(*by).agg(F.percentile(F.col("value").cast("double"), [c / 100 for c in CENTILES]).alias("_found"))
        each = F.array(*(F.struct(F.lit(c).alias("centile"), F.get("_found", F.lit(i)).alias("value")) for i, c in enumerate(CENTILES)))
        return exact.select(*by, F.explode(each).alias("_c")).select("_c.centile", *by, "_c.value")
    counted = bracketed(matrix.select(*by, F.col("value").cast("double").alias("value")), by, groups)
    until = Window.partitionBy(*by, "centile").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("_rows") - 1) * F.col("centile") / F.lit(100.0)
    ranked = counted.withColumn("_end", F.sum("_n").over(until)).withColumn("_at", at)
    # The two places next to a centile's are weighted by their distance from it.
    weights = [F.when((place < F.col("_end")) & (place >= F.col("_end") - F.col("_n")), 1 - F.abs(F.col("_at") - place)).otherwise(0.0) for place in (F.floor("_at"), F.floor("_at") + 1)]
    weighted = ranked.withColumn("_weight", F.when(F.col("_value").isNotNull(), weights[0] + weights[1]).otherwise(0.0))
    total = F.sum(F.when(F.col("_weight") > 0, F.col("_value") * F.col("_weight")))
    missed = F.raise_error(F.lit("a centile is outside its bracket")).cast("double")
    found = F.when(F.max("_rows") == 0, None).when(F.abs(F.sum("_weight") - 1) < 1e-6, total).otherwise(missed)
    return weighted.groupBy("centile", *by).agg(found.alias("value")).select("centile", *by, "value")


def bracketed(cells: DataFrame, by: list[str], groups: int | None = None) -> DataFrame:
    """(*by, centile, _value, _n, _rows): the distinct values inside each centile's bracket, and one row (missing value)
    for all below it. _n is how often they occur, _rows the number of the group's values."""
    points = [min(max(c / 100 + side * width, 0.0), 1.0) for c in CENTILES for _, width in BRACKETS for side in (-1, 1)]
    sketched = cells.groupBy(*by).agg(
        F.count("value").alias("_rows"), F.percentile_approx("value", points, SKETCH_ACCURACY).alias("_points")
    )
    known = sketched.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_rows", _brackets().alias("_brackets"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    placed = cells.join(checked_broadcast(known, groups), same)
    value = F.col("value")
    around = F.filter("_brackets", lambda b: value.isNull() | b["high"].isNull() | (value <= b["high"]))
    inside = F.when(F.col("_b.low").isNull() | (value >= F.col("_b.low")), value)
    return (
        placed.select(*by, "_rows", value, F.explode(around).alias("_b"))
        .groupBy(*by, F.col("_b.centile").alias("centile"), inside.alias("_value"))
        .agg(F.count("value").alias("_n"), F.first("_rows").alias("_rows"))
    )


def _brackets() -> Column:
    """Array of (centile, low, high); a missing border is open."""
    out = []
    for i, c in enumerate(CENTILES):
        low = high = F.lit(None).cast("double")
        for j, (least, _) in reversed(list(enumerate(BRACKETS))):
            at = 2 * (i * len(BRACKETS) + j)
            low = F.when(F.col("_rows") >= least, F.get("_points", F.lit(at))).otherwise(low)
            high = F.when(F.col("_rows") >= least, F.get("_points", F.lit(at + 1))).otherwise(high)
        out.append(F.struct(F.lit(c).alias("centile"), low.alias("low"), high.alias("high")))
    return F.array(*out)
