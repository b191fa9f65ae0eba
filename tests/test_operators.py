from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weirflow import operators as ops
from weirflow.plans.ordering import in_ranges, row_numbers


def test_aggregate_by_group(spark, as_rows):
    df = spark.createDataFrame([("NYC", 70000), ("NYC", 80000), ("LA", 60000), (None, 1), (None, None)], "city string, salary int")
    got = ops.aggregate(df, ["city"], {"total": "sum(salary)", "mean": "avg(salary)", "n": "count(salary)"})
    assert as_rows(got) == as_rows(spark.createDataFrame([("NYC", 150000, 75000.0, 2), ("LA", 60000, 60000.0, 1), (None, 1, 1.0, 2)], got.schema))


def test_aggregate_without_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert ops.aggregate(df, [], {"n": "count()", "s": "sum(x)"}).collect() == [(2, 3)]
    assert ops.aggregate(df.filter("x > 5"), [], {"n": "count()"}).collect() == []


def test_first_and_last_skip_null_and_follow_the_order(spark):
    df = spark.createDataFrame([(3, "g", "c"), (1, "g", None), (2, "g", "b"), (4, "g", None)], "seq int, grp string, val string")
    got = ops.aggregate(df, ["grp"], {"f": "first(val)", "l": "last(val)"}, order_by=["seq"]).first()
    assert (got.f, got.l) == ("b", "c")
    with pytest.raises(ValueError):
        ops.aggregate(df, ["grp"], {"f": "first(val)"})
    with pytest.raises(KeyError):
        ops.aggregate(df, ["grp"], {"f": "sum(nothing)"})


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (None, "N")], "id int, name string")
    right = spark.createDataFrame([(1, 95), (2, 87), (4, 72), (None, 0)], "id int, score int")
    return left, right


@pytest.mark.parametrize(
    ("how", "result"),
    [
        ("inner", {(1, "A", 95), (2, "B", 87), (None, "N", 0)}),
        ("left", {(1, "A", 95), (2, "B", 87), (3, "C", None), (None, "N", 0)}),
        ("right", {(1, "A", 95), (2, "B", 87), (4, None, 72), (None, "N", 0)}),
        ("outer", {(1, "A", 95), (2, "B", 87), (3, "C", None), (4, None, 72), (None, "N", 0)}),
    ],
)
def test_joins(sides, how, result):
    assert {tuple(r) for r in ops.join(*sides, "id", how).collect()} == result


def test_join_multiplicity_suffixes_and_errors(spark, sides):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id int, value string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "id int, value string")
    got = ops.join(a, b, "id", suffixes=("_l", "_r"))
    assert got.columns == ["id", "value_l", "value_r"] and got.count() == 4
    for how in ("cross", "semi", "anti"):
        with pytest.raises(ValueError):
            ops.join(a, b, "id", how)
    with pytest.raises(KeyError):
        ops.join(a, b, "nothing")


def test_join_of_a_frame_with_itself(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert ops.join(df, df, ["id"], "outer").count() == 2


@pytest.mark.parametrize(
    ("values", "size", "step", "aggregation", "result"),
    [
        ([10, 20, 30, 40, 50], 3, 1, "avg", [None, None, 20.0, 30.0, 40.0]),
        ([1, 2, 3, 4], 2, 1, "sum", [None, 3, 5, 7]),
        ([5, 1, 3, 8], 3, 1, "min", [None, None, 1, 1]),
        ([5, 1, 3, 8], 3, 1, "max", [None, None, 5, 8]),
        ([1, 2, 3, 4], 2, 2, "sum", [None, 3, None, 7]),
        ([1, None, 3], 2, 1, "sum", [None, 1, 3]),
        ([None, None], 1, 1, "sum", [None, None]),
        ([1, 2], 5, 1, "sum", [None, None]),
        ([7, 8], 1, 1, "count", [1, 1]),
    ],
)
def test_row_windows(spark, values, size, step, aggregation, result):
    df = spark.createDataFrame(list(enumerate(values)), "seq int, v int")
    column = "" if aggregation == "count" else "v"
    out = ops.row_window(df, size, step, aggregation, column, order_by=["seq"])
    assert [r[-1] for r in out.orderBy("seq").collect()] == result
    assert out.columns[-1] == f"{column}_window_{aggregation}"


def test_row_windows_across_blocks(spark, monkeypatch):
    from weirflow.operators import window

    monkeypatch.setattr(window, "BLOCK", 16)
    df = spark.range(0, 200).select("id", (F.col("id") * 7 % 31).alias("v"))
    got = [r[-1] for r in ops.row_window(df, 5, 1, "sum", "v", order_by=["id"]).orderBy("id").collect()]
    values = [i * 7 % 31 for i in range(200)]
    assert got == [None if i < 4 else sum(values[i - 4 : i + 1]) for i in range(200)]


@pytest.mark.parametrize("bad", [{"size": 0}, {"size": 2, "step": 0}, {"size": 2, "aggregation": "median"}, {"size": 2, "aggregation": "sum"}])
def test_row_window_arguments(spark, bad):
    with pytest.raises(ValueError):
        ops.row_window(spark.range(3), order_by=["id"], **bad)


def test_row_window_of_nothing(spark):
    assert ops.row_window(spark.range(0), 2, 1, "sum", "id", order_by=["id"]).collect() == []


def test_numbers_follow_the_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    ranged = in_ranges(df, ["k"])
    assert ranged.select((row_numbers(ranged) == F.col("k")).alias("same")).distinct().collect() == [(True,)]


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, None)], "seq int, k string, v string")
    assert {tuple(r) for r in ops.deduplicate(df, ["k"], "first", ["seq"]).collect()} == {(1, "a", "x"), (3, None, "z")}
    assert {tuple(r) for r in ops.deduplicate(df, ["k"], "last", ["seq"]).collect()} == {(2, "a", "y"), (4, None, None)}
    assert ops.deduplicate(df, ["k"]).count() == 2
    with pytest.raises(ValueError):
        ops.deduplicate(df, ["k"], "any")


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2, 9)], "b string, a int, c int")
    assert {tuple(r) for r in ops.union_all([a, b]).collect()} == {(1, "x", None), (2, "y", 9)}
    with pytest.raises(ValueError):
        ops.union_all([])


def test_top(spark):
    assert [r.id for r in ops.top_n(spark.range(50), ["id"], 3).collect()] == [49, 48, 47]
    assert [r.id for r in ops.top_n(spark.range(50), ["id"], 2, False, "id > 10").collect()] == [11, 12]


@pytest.mark.parametrize("operator", [lambda d: ops.filter_rows(d, "a > 1"), lambda d: ops.map_columns(d, {"b": "a + 1"}), lambda d: ops.aggregate(d, ["a"], {"n": "count()"}), lambda d: ops.join(d, d, "a"), lambda d: ops.deduplicate(d, ["a"], "first", ["a"]), lambda d: ops.union_all([d, d])])
def test_nothing_in_nothing_out(spark, operator):
    assert operator(spark.createDataFrame([], "a int")).collect() == []
