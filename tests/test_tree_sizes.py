"""Trees over features of many categories and targets of many classes."""

import pytest

from tablewright.operators import tree
from tablewright.operators.features import encode, encoders, filter_features


def test_feature_of_many_categories(spark):
    frame = spark.range(24_000).selectExpr("lpad(id % 12000, 5, '0') AS s", "CAST(id % 12000 < 4000 AS string) AS t")
    assert filter_features(frame, ["s"]) == (["s"], {})
    codes = {(r["s"], r["x0"]) for r in encode(frame, encoders(frame, ["s"])).collect()}
    assert codes == {(f"{i:05}", float(i)) for i in range(12_000)}
    got = tree.analyze(frame, ["s"], "t")
    assert got.metrics["accuracy"] == 1 and got.leaf_count == 2 and sorted(len(r.predicates[0].value) for r in got.rules) == [4_000, 8_000]


def test_target_of_many_classes(spark):
    frame = spark.range(6_000).selectExpr("id % 1200 AS x", "CASE WHEN id % 1200 < 500 THEN 'a' ELSE 'k' || id % 1200 END AS t", "IF(id % 7 = 0, NULL, CAST(id % 5 AS double)) AS z")
    got = tree.analyze(frame.where("x < 500 or x >= 0").unionAll(frame.selectExpr("x", "concat(t, 'b')", "z")), ["x", "z"], "t", max_depth=2)
    assert got.metrics["accuracy"] > 2_500 / 12_000 and got.rules[0].prediction == "a"


@pytest.mark.parametrize("target", ["t", "u"])
def test_classes_as_rows_split_like_columns(spark, monkeypatch, target):
    frame = spark.range(900).selectExpr("IF(id % 11 = 0, NULL, id * 37 % 101) AS x", "IF(id % 5 = 0, NULL, 's' || id * 13 % 29) AS s", "'k' || (id * 37 % 101 DIV 9 + id % 2) AS t", "id % 7 + IF(id % 11 = 0, 3, 0) AS u")
    columns = tree.analyze(frame, ["x", "s"], target, task="classification", max_depth=4)
    monkeypatch.setattr(tree, "CLASS_COLUMNS", 1)
    assert tree.analyze(frame, ["x", "s"], target, task="classification", max_depth=4) == columns
    assert columns.leaf_count > 3
