"""Aggregates, transforms, table functions and window targets that users add: odd cases."""

import pytest
from pyspark.sql import functions as F

from wavefold.operators import extensions as X
from wavefold.plans.extension_queries import bursts


def test_unknown_names_and_bad_functions_are_errors(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0)], "k string, v double")
    with pytest.raises(KeyError, match="no aggregate 'nope'"):
        X.aggregate(d, ["k"], "v", ["nope"])
    with pytest.raises(ValueError):
        X.register_aggregate("", F.sum)
    with pytest.raises(ValueError):
        X.register_transform("x", 3)
    X.register_aggregate("half", lambda x: F.sum(x) / 2)
    assert {tuple(r) for r in X.aggregate(d, ["k"], "v", ["half", "vpp"]).collect()} == {("a", 0.5, 0.0), (None, 1.5, 0.0)}
    assert X.aggregate(d.where("false"), ["k"], "v", ["half"]).count() == 0


def test_aggregates_are_summed_up_before_the_shuffle(spark):
    plan = X.aggregate(spark.range(100).selectExpr("id % 3 as k", "double(id) as v"), ["k"], "v", ["rms", "energy"])._jdf.queryExecution().toString()
    assert "partial_avg" in plan and "partial_sum" in plan


def test_table_function_over_nulls_and_empty_arrays(spark):
    X.register_table_function(spark, "test_bursts", bursts, "start long, stop long, peak double")
    d = spark.createDataFrame([(1, [0.0, 3.0, -4.0, 0.0, 2.0]), (2, []), (3, None), (4, [None, 5.0])], "id int, x array<double>")
    got = {tuple(r) for r in spark.sql("select d.id, b.* from {d} d, lateral test_bursts(d.x, 1.0D) b", d=d).collect()}
    assert got == {(1, 1, 3, 4.0), (1, 4, 5, 2.0), (4, 1, 2, 5.0)}


def test_window_targets(spark):
    rows = [(1, 0, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, 1, [9.0, 8.0, 7.0, 6.0]), (1, 2, [0.0, 1.0, 0.0, 1.0, 1.0]), (2, 0, [1.0]), (3, 0, [1.0, 2.0]), (4, 2, [5.0, 6.0]), (5, None, [1.0, 1.0]), (6, 1, None)]
    d = spark.createDataFrame(rows, "rec long, ch int, samples array<double>")
    got = {(r.rec, r.seg): (r.samples, r.target) for r in X.window_targets(d, [2], 2).collect()}
    assert got == {(1, 0): ([[1, 2], [9, 8]], [1]), (1, 1): ([[3, 4], [7, 6]], [1]), (3, 0): ([[1, 2]], []), (4, 0): ([], [6])}
    every = {(r.rec, r.seg): r.target for r in X.window_targets(d, [2], 2, last_only=False).collect()}
    assert every[1, 1] == [[0, 1]] and every[3, 0] == []
    assert X.window_targets(d.where("false"), [], 2).count() == 0


def test_target_names():
    assert X.check_targets(None, ["age"]) == ([], [])
    assert X.check_targets("age", ["age"]) == (["age"], [])
    assert X.check_targets(("epilepsy", "age", "sex"), ["age"]) == (["epilepsy", "age", "sex"], ["sex"])
    with pytest.raises(ValueError):
        X.check_targets(3, [])
