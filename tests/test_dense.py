import datetime
import math

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from scriptline.operators import dense, star
from scriptline.operators.ids import dense_ids


def day(i):
    return datetime.date(2025, i, 1)


def matrix(spark, values, kind="bigint"):
    cells = [(row, day(i + 1), v) for row, line in values.items() for i, v in enumerate(line)]
    return spark.createDataFrame(cells, f"row string, date date, value {kind}")


def months(spark, n):
    return spark.createDataFrame([(day(i + 1),) for i in range(n)], "date date")


def lines(df, row):
    found = {}
    for r in df.orderBy("date").collect():
        found.setdefault(r[row], []).append(r.value)
    return found


INPUT = {"A": [0, 1, 2], "B": [3, 4, 5], "C": [6, 7, 8], "D": [9, 0, 1]}


@pytest.mark.parametrize(
    "members, expected",
    [
        ([("one", "A"), ("one", "C"), ("two", "B"), ("two", "D")], {"one": [6, 8, 10], "two": [12, 4, 6]}),
        ([("H", "C"), ("I", "B"), ("J", "D")], {"H": [6, 7, 8], "I": [3, 4, 5], "J": [9, 0, 1]}),
        ([("X", "A"), ("X", "B"), ("Y", "D"), ("Y", "_"), ("Z", "*")], {"X": [3, 5, 7], "Y": [9, 0, 1], "Z": [0, 0, 0]}),
        ([("X", "A"), ("E", None)], {"X": [0, 1, 2], "E": [0, 0, 0]}),
    ],
)
def test_group_rows(spark, members, expected):
    groups = spark.createDataFrame(members, "g string, row string")
    assert lines(dense.group_rows(matrix(spark, INPUT), "row", groups, "g", months(spark, 3)), "g") == expected


def test_row_in_two_groups_fails(spark):
    groups = spark.createDataFrame([("X", "A"), ("Y", "A")], "g string, row string")
    with pytest.raises(Exception, match="mapped to multiple output groups"):
        dense.group_rows(matrix(spark, INPUT), "row", groups, "g", months(spark, 3)).collect()


def test_scale_and_divide(spark):
    assert lines(dense.scale(matrix(spark, {"A": [1.0, None], "B": [2.0, 3.0]}, "double"), 10), "row") == {"A": [10, None], "B": [20, 30]}
    top, below = matrix(spark, {"A": [0, 1], "B": [0, 1]}), matrix(spark, {"A": [0, 0], "B": [1, 1]})
    assert lines(dense.divide(top, below, "row"), "row") == {"A": [None, None], "B": [0, 1]}


def test_drop_zero_rows(spark):
    values = {"A": [1.0, 2.0], "B": [0.0, 0.0], "C": [0.0, 3.0], "D": [None, 0.0]}
    assert set(lines(dense.drop_zero_rows(matrix(spark, values, "double"), "row"), "row")) == {"A", "C", "D"}


def test_grouped_sum_keeps_the_number_type(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25)], "k string, n int, x float")
    found = dense.grouped_sum(df, ["k"], ["n", "x"])
    assert dict(found.dtypes) == {"k": "string", "n": "bigint", "x": "double"} and rows(found) == [("a", 3, 0.75)]
    with pytest.raises(TypeError):
        dense.grouped_sum(df, ["n"], ["k"])


def test_any_number_of_months(spark):
    many = spark.range(300).select(F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    assert dense.zero_cells(spark.range(2), many).count() == 600
    ids = {r.date: r.id for r in star.date_dim(many).collect()}
    assert sorted(ids.values()) == list(range(300)) and ids[max(ids)] == 0
    assert dense.zero_cells(spark.range(2), many.limit(0)).isEmpty()


def test_missing_to_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "v double")
    assert {r[0] for r in df.select(dense.missing_to_null(F.col("v"))).collect()} == {1.0, None}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.floats(0, 100)), min_size=2, max_size=2), min_size=1, max_size=25))
def test_centiles_agree_with_numpy(spark, values):
    df = matrix(spark, {f"r{i}": line for i, line in enumerate(values)}, "double")
    table = np.array([[np.nan if v is None else v for v in line] for line in values])
    found = {(r.centile, r.date): r.value for r in dense.centiles(df).collect()}
    for column in range(2):
        present = table[:, column][~np.isnan(table[:, column])]
        for c in dense.CENTILES:
            value = found[c, day(column + 1)]
            assert value is None if not len(present) else value == pytest.approx(np.percentile(present, c), abs=1e-9)


def test_centiles_of_ties(spark):
    values = [0.0] * 900 + [float(i * i % 97) for i in range(100)]
    df = spark.createDataFrame([(f"r{i}", day(1), v) for i, v in enumerate(values)], "row string, date date, value double")
    found = {r.centile: r.value for r in dense.centiles(df).collect()}
    assert found == {c: pytest.approx(np.percentile(values, c)) for c in dense.CENTILES}


def test_dense_ids_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5000).alias("k"))
    assert all(r.k == r.id - 1 for r in dense_ids(df, [F.col("k")], start=1).collect())
    down = dense_ids(df, [F.col("k").desc()]).collect()
    assert len(down) == 5000 and all(r.k == 4999 - r.id for r in down)


def test_an_outlier_leaves_the_brackets_small(spark):
    """40,000 values close together and one far away, of many ties: exact, with few rows to sort."""
    rng = np.random.default_rng(1)
    values = np.concatenate([np.round(5 + rng.random(39_999) / 1000, 7), [1e300]])
    df = spark.createDataFrame(pd.DataFrame({"date": [day(1)] * len(values), "value": values})).repartition(7)
    found = {r.centile: r.value for r in dense.centiles(df).collect()}
    assert found == {c: pytest.approx(np.percentile(values, c), abs=1e-12) for c in dense.CENTILES}
    sizes = dense.bracketed(df, ["date"]).groupBy("centile").count().collect()
    assert len(sizes) == 9 and max(r["count"] for r in sizes) < 0.01 * len(values)


@pytest.mark.parametrize("size", [1, 2, 99, 100, 101, 999, 1000, 1001, 9_999, 10_001, 60_000])
def test_centiles_of_all_sizes(spark, size):
    rng = np.random.default_rng(size)
    values = np.round(np.exp(rng.standard_normal(size) * 3), rng.integers(0, 4))
    df = spark.createDataFrame(pd.DataFrame({"date": [day(1)] * size, "value": values})).repartition(9)
    for groups in (None, 1):
        found = {r.centile: r.value for r in dense.centiles(df, groups=groups).collect()}
        assert found == {c: pytest.approx(np.percentile(values, c), rel=1e-12) for c in dense.CENTILES}


def test_sums_have_the_same_bits_for_every_partitioning(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_normal(3000) * 10.0 ** rng.integers(-6, 9, 3000), [0.1] * 1000]).tolist()
    found = set()
    for i in range(20):
        rng.shuffle(values)
        df = spark.createDataFrame([(1, v) for v in values], "k int, v double").repartition(1 + i)
        found.add(dense.grouped_sum(df, ["k"], ["v"]).first().v)
    assert len(found) == 1 and found.pop() == pytest.approx(math.fsum(values), rel=1e-12)
    odd = [(1, None), (1, 2.5), (2, float("nan")), (2, 1.0), (3, float("inf")), (3, 1.0), (4, None), (5, -0.75), (5, -1e15)]
    sums = {r.k: r.v for r in dense.grouped_sum(spark.createDataFrame(odd, "k int, v double"), ["k"], ["v"]).collect()}
    assert sums[1] == 2.5 and math.isnan(sums[2]) and sums[3] == math.inf and sums[4] is None and sums[5] == -1e15 - 0.75
