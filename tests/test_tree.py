"""Features, exact splits against brute force, rules and results."""

import numpy as np
import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from tablewright import DataFrameToolkit, DecisionTreeModule
from tablewright.functions.rules import ClassificationRule, DecisionTreeResult, Predicate, importances, simplify
from tablewright.operators.features import encode, encoders, filter_features, infer_task
from tablewright.operators.order import running
from tablewright.operators.tree import Tree, analyze, grow


def test_predicates():
    assert Predicate(variable="a", operator="<=", value=3).eval(3) and not Predicate(variable="a", operator="not in", value={"x"}).eval("x")
    assert str(Predicate(variable="c", operator="in", value={"b", "a"})) == "c in {a, b}"
    with pytest.raises(ValidationError):
        Predicate(variable="a", operator="in", value=3)
    with pytest.raises(ValidationError):
        Predicate(variable="a", operator="<", value={1.0})
    p = lambda op, v, name="a": Predicate(variable=name, operator=op, value=v)
    assert [str(x) for x in simplify([p("<=", 5), p(">", 1), p("<=", 3), p(">", 2), p("in", {"x", "y"}, "b"), p("in", {"y"}, "b")])] == ["a <= 3.0", "a > 2.0", "b in {y}"]
    with pytest.raises(ValueError, match="contradict"):
        simplify([p("in", {"x"}), p("in", {"y"})])


def test_importances():
    assert importances({"a": 1.0, "b": 2.0, "c": 0.0}) == {"b": 0.6667, "a": 0.3333} and importances({"a": 0.0}) == {}
    rule = ClassificationRule(predicates=[], prediction="x", samples=1, confidence=1)
    base = {"task": "classification", "features": [], "target": "t", "rules": [rule], "feature_importances": {}, "metrics": {}, "sample_count": 1, "depth": 0, "leaf_count": 1}
    DecisionTreeResult(**base)
    for bad in ({"leaf_count": 2}, {"features": ["a"], "feature_importances": {"a": 0.5}}, {"features": ["a"]}, {"task": "regression"}):
        with pytest.raises(ValidationError):
            DecisionTreeResult(**base | bad)


def test_running_sums_cross_ranges(spark):
    rows = spark.range(200).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v", "id AS n").repartition(7)
    with running(rows, ["g"], "v", ["n"]) as summed:
        got = summed.collect()
    for r in got:
        assert r["run_n"] == sum(x for x in range(200) if x % 2 == r["g"] and x <= r["v"])
        assert r["next_value"] == (r["v"] + 2 if r["v"] + 2 < 200 else None)
    assert len(got) == 200


def test_feature_filter_and_tasks(spark):
    rows = [(i, f"id{i}", f"k{i % 5}", None, 1, i % 3, i / 7, i % 2 == 0, [i]) for i in range(100)]
    frame = spark.createDataFrame(rows, "n long, unique string, kind string, none string, same int, few int, ratio double, flag boolean, nested array<long>")
    kept, why = filter_features(frame, frame.columns)
    assert kept == ["n", "kind", "few", "ratio", "flag"]
    assert why == {"unique": "over nine tenths of the rows have a label of their own", "none": "no value in any row", "same": "the same in every row", "nested": "a type that cannot be split on"}
    assert [infer_task(frame, c) for c in ("n", "kind", "few", "ratio", "flag")] == ["regression", "classification", "classification", "regression", "classification"]
    assert infer_task(frame, "few", "regression") == "regression"


def test_encoding_keeps_null_labels_last(spark):
    frame = spark.createDataFrame([("b",), (None,), ("a",), ("b",), (None,)], "s string")
    assert sorted(r["x0"] for r in encode(frame, encoders(frame, ["s"])).collect()) == [0.0, 1.0, 1.0, 2.0, 2.0]


def _brute(xs, y, floor):
    """Best (gain, -feature, -threshold, missing left) by trying everything."""
    cost = lambda v: sum((v == c).sum() ** 2 for c in np.unique(y)) / len(v) if len(v) else 0
    best = None
    for f, x in enumerate(xs):
        known = np.unique(x[~np.isnan(x)])
        for a, b in zip(known[:-1], known[1:]):
            for left in (True, False):
                if not left and not np.isnan(x).any():
                    continue
                side = (x <= a) | (np.isnan(x) if left else False)
                if min(side.sum(), (~side).sum()) >= floor:
                    option = (round(cost(y[side]) + cost(y[~side]) - cost(y), 9), -f, -(a + (b - a) / 2), left)
                    best = option if best is None or option > best else best
    return best


def test_two_levels_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    xs = [rng.integers(0, 12, 300).astype(float), rng.normal(0, 1, 300).round(1)]
    xs[1][rng.random(300) < 0.2] = np.nan
    y = ((xs[0] > 6) ^ (np.nan_to_num(xs[1], nan=2.0) > 0.5)).astype(int) + (rng.random(300) < 0.1)
    rows = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b), 1, *(int(v == k) for k in range(3))) for a, b, v in zip(*xs, y)], "x0 double, x1 double, n long, c0 long, c1 long, c2 long")
    tree = grow(rows, 2, ["c0", "c1", "c2"], 8, 2)

    def check(node, mask):
        best = _brute([x[mask] for x in xs], y[mask], 8)
        if node not in tree.splits:
            return
        s = tree.splits[node]
        assert (s.gain, -s.feature, -s.threshold, s.missing_left) == pytest.approx(best)
        side = (xs[s.feature] <= s.threshold) | (np.isnan(xs[s.feature]) if s.missing_left else False)
        check(2 * node, mask & side)
        check(2 * node + 1, mask & ~side)

    check(1, np.ones(300, bool))
    assert tree.depth == 2
    assert {r[0] for r in rows.select(tree.node()).distinct().collect()} == set(tree.leaves())


def test_rules_partition_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(1, 72)), float(rng.normal(60, 20)), ["basic", "plus", "pro"][int(rng.integers(3))], None if rng.random() < 0.1 else bool(rng.random() < 0.5)) for _ in range(200)]
    rows = [(*r, "yes" if r[0] < 20 and r[2] != "pro" else "no", r[0] * 2.0 + r[1]) for r in rows]
    frame = spark.createDataFrame(rows, "tenure long, spend double, plan string, flag boolean, churn string, value double")
    found = analyze(frame, ["tenure", "spend", "plan", "flag"], "churn")
    assert found.task == "classification" and found.metrics["accuracy"] > 0.95 and sum(r.samples for r in found.rules) == 200
    complete = frame.where("flag IS NOT NULL")
    assert sum(complete.where(_all(r)).count() for r in found.rules) == complete.count()
    value = analyze(frame, ["tenure", "spend"], "value", max_depth=3)
    assert value.task == "regression" and 0 < value.metrics["r_squared"] <= 1 and value.depth <= 3 and all(r.std >= 0 for r in value.rules)


def _all(rule):
    test = F.lit(True)
    for p in rule.predicates:
        test = test & p.column()
    return test


def test_no_split_is_one_leaf(spark):
    frame = spark.createDataFrame([(i % 2, "a" if i % 4 < 2 else "b") for i in range(40)], "x long, y string")
    found = analyze(frame, ["x"], "y")
    assert (found.depth, found.leaf_count, found.features, found.feature_importances) == (0, 1, [], {}) and Tree().leaves() == [1]


def test_tool_turns_value_errors_into_answers(spark):
    kit = DataFrameToolkit()
    rows = [(i, float(i), f"id{i}", "x" if i < 15 else "y", None) for i in range(30)]
    kit.register_dataframe("t", spark.createDataFrame(rows, "n long, v double, u string, y string, none string"))
    tool = next(t for t in kit.get_tools(DecisionTreeModule) if t.name == "analyze_with_decision_tree")
    call = lambda **k: tool.invoke({"dataframe": "t", "target": "y"} | k)
    assert call().metrics["accuracy"] == 1.0 and call(dataframe="none").error_type == "DataFrameNotFound"
    for bad, why in (({"target": "nope"}, "not found"), ({"features": ["nope"]}, "not found"), ({"features": []}, "No valid feature"), ({"features": ["u"]}, "No valid feature"), ({"features": ["y"]}, "cannot be a feature"), ({"target": "none"}, "only null"), ({"task": "x"}, "task"), ({"max_depth": 7}, "max_depth"), ({"min_samples_leaf": 31}, "min_samples_leaf"), ({"task": "regression"}, "float")):
        found = call(**bad)
        assert found.error_type == "InvalidArgument" and why in found.message, (bad, found)
    kit.unregister_dataframe("t")


def test_rules_part_all_rows_with_missing_values(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(600):
        g = [None, "None", "a", "b"][int(rng.integers(4))]
        x = None if rng.random() < 0.3 else float(rng.integers(0, 20))
        b = [None, True, False][int(rng.integers(3))]
        rows.append((g, x, b, ("p" if g is None else "q" if g == "None" else "r" if x is None else "s" if x > 9 else "t") + str(b is None)))
    frame = spark.createDataFrame(rows, "g string, x double, b boolean, y string")
    result = analyze(frame, ["g", "x", "b"], "y")
    kinds = {f.name: f.dataType for f in frame.schema}
    matches = []
    for rule in result.rules:
        test = F.lit(True)
        for p in rule.predicates:
            test = test & p.column(kinds[p.variable])
        matches.append(test.cast("int"))
        assert frame.where(test).count() == rule.samples
    assert frame.where(sum(matches[1:], matches[0]) != 1).count() == 0
    assert any(p.nulls for r in result.rules for p in r.predicates)
