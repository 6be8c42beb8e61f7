"""Calls whose jobs run side by side."""

import threading

import pytest

from tablewright import DataFrameToolkit
from tablewright.sources.together import together


def test_results_keep_their_order(spark):
    frames = [spark.range(n) for n in (5, 0, 7, 3, 1, 2)]
    assert together([f.count for f in frames]) == [5, 0, 7, 3, 1, 2]
    assert together([]) == [] and together([lambda: 1]) == [1] and together([lambda: 1, lambda: 2], 1) == [1, 2]


def test_threads_have_the_callers_properties(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("tablewright.test", "here")
    try:
        assert together([lambda: (sc.getLocalProperty("tablewright.test"), threading.current_thread().name.startswith("tablewright"))] * 3) == [("here", True)] * 3
    finally:
        sc.setLocalProperty("tablewright.test", None)


def test_first_error_is_raised_after_all_that_began(spark):
    ended = []

    def slow():
        spark.range(10).count()
        ended.append(1)

    def wrong(text):
        raise ValueError(text)

    with pytest.raises(ValueError, match="one"):
        together([slow, lambda: wrong("one"), lambda: wrong("two"), slow], 4)
    assert ended == [1, 1]


def test_a_faulty_table_among_good_ones_leaves_nothing(spark):
    kit = DataFrameToolkit()
    good = {f"t{i}": spark.range(i + 1).selectExpr("id", "id * 2 AS two") for i in range(5)}
    with pytest.raises(ValueError, match="not unique"):
        kit.register_dataframes({**good, "bad": spark.sql("SELECT 1 AS a, 2 AS A")})
    assert kit.references == ()
    assert [(r.name, r.num_rows) for r in kit.register_dataframes(good)] == [(f"t{i}", i + 1) for i in range(5)]
    again = DataFrameToolkit.from_state(kit.export_state(), good)
    assert again.references == kit.references
    changed = good | {"t3": spark.range(4).selectExpr("id", "id * 3 AS two")}
    with pytest.raises(ValueError, match="'t3'"):
        DataFrameToolkit.from_state(kit.export_state(), changed)
