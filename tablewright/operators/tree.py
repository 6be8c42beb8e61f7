"""Exact decision trees, a level at a time, with aggregations only.

For a level, every (node, feature, value) is summed up once; running sums in order give the left side of every threshold,
node totals the right one. What comes to the driver is one best split per node.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_number, named
from tablewright.functions.rules import ClassificationRule, DecisionTreeResult, Predicate, RegressionRule, importances, simplify
from tablewright.operators.features import Encoder, encode, encoders, filter_features, infer_task
from tablewright.operators.order import running

#: Fixed values.
MAX_DEPTH = 6
LEAF_FLOOR = 5
LEAF_SHARE = 0.02
THRESHOLD_PLACES = 4
#: Classes of a target that are summed as columns; more are summed as rows, with the same splits.
CLASS_COLUMNS = 1_000
LEAST_GAIN = 1e-9


@dataclass
class Split:
    feature: int
    threshold: float
    missing_left: bool
    gain: float
    missing: bool = False  # whether the node has missing values of the feature


@dataclass
class Tree:
    """Splits by node: the root is 1, the children of n are 2n and 2n + 1."""

    splits: dict[int, Split] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        """Leaves in order of a walk that goes left first."""
        found, stack = [], [1]
        while stack:
            n = stack.pop()
            if n in self.splits:
                stack += [2 * n + 1, 2 * n]
            else:
                found.append(n)
        return found

    @property
    def depth(self) -> int:
        return max(n.bit_length() - 1 for n in self.leaves())

    def node(self, n: int = 1) -> Column:
        """The leaf of a row, from its x columns."""
        if n not in self.splits:
            return F.lit(n)
        s = self.splits[n]
        x = F.col(f"x{s.feature}")
        left = (x.isNull() | (x <= s.threshold)) if s.missing_left else (x <= s.threshold)
        return F.when(left, self.node(2 * n)).otherwise(self.node(2 * n + 1))


def _side(sums: Sequence[Column], n: Column) -> Column:
    return sum((s * s for s in sums[1:]), sums[0] * sums[0]) / n


def best_splits(rows: DataFrame, features: int, sums: Sequence[str], floor: int, open_nodes: Sequence[int]) -> dict[int, Split]:
    """The best split of each open node of ``rows`` (node, x0 .., n, sums): the largest decrease of n times impurity.

    Impurity is Gini over class counts, or variance over a sum of (centred) values: both are what is left of sum^2 / n.
    Equal gains go to the first feature, then the lowest threshold, then missing values left.
    """
    stats = ["n", *[s for s in sums if s != "n"]]
    explode = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(features))))
    mine = rows.where(F.col("node").isin(list(open_nodes))).select("node", explode.alias("e"), *stats).select("node", "e.f", "e.v", *stats)
    grouped = mine.groupBy("node", "f", "v").agg(*(F.sum(s).alias(s) for s in stats)).persist()
    whole = grouped.groupBy("node", "f").agg(*(F.sum(s).alias(f"all_{s}") for s in stats), *(F.sum(F.when(F.col("v").isNull(), F.col(s)).otherwise(0)).alias(f"none_{s}") for s in stats))

    def sides(missing_left: bool) -> tuple[Column, Column, Column]:
        left = {s: F.col(f"run_{s}") + (F.col(f"none_{s}") if missing_left else F.lit(0)) for s in stats}
        right = {s: F.col(f"all_{s}") - left[s] for s in stats}
        gain = _side([left[s] for s in sums], left["n"]) + _side([right[s] for s in sums], right["n"]) - _side([F.col(f"all_{s}") for s in sums], F.col("all_n"))
        return left["n"], right["n"], gain

    try:
        with running(grouped.where("v is not null"), ["node", "f"], "v", stats) as ordered:
            return _best(ordered.where("next_value is not null").join(whole, ["node", "f"]), sides, floor)
    finally:
        grouped.unpersist()


def _best(ordered: DataFrame, sides: Callable[[bool], tuple[Column, Column, Column]], floor: int) -> dict[int, Split]:
    """The best split of each node; ``sides`` tells the rows left and right and the gain, with missing values left or right."""
    options = []
    for missing_left in (True, False):
        left, right, gain = sides(missing_left)
        fits = (left >= floor) & (right >= floor) & (F.lit(missing_left) | (F.col("none_n") > 0))
        threshold = F.col("v") + (F.col("next_value") - F.col("v")) / 2
        options.append(F.when(fits, F.struct(F.round(gain, 9).alias("gain"), (-F.col("f")).alias("f"), (-threshold).alias("t"), F.lit(missing_left).alias("left"), (F.col("none_n") > 0).alias("none"))))
    best = ordered.select("node", F.explode(F.array(*options)).alias("o")).where("o is not null").groupBy("node").agg(F.max("o").alias("o")).collect()
    return {r["node"]: Split(-r["o"]["f"], -r["o"]["t"], r["o"]["left"], r["o"]["gain"], r["o"]["none"]) for r in best if r["o"]["gain"] > LEAST_GAIN}


def best_class_splits(rows: DataFrame, features: int, floor: int, open_nodes: Sequence[int]) -> dict[int, Split]:
    """As ``best_splits``, of rows (node, x0 .., n, class) with any number of classes.

    Classes stay rows. With l, a and m the rows of a class left of a threshold, in all and missing, what Gini needs are
    running sums of the growth of l * l, a * l and m * l.
    """
    explode = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(features))))
    mine = rows.where(F.col("node").isin(list(open_nodes))).select("node", explode.alias("e"), "n", "class").select("node", "e.f", "e.v", "n", "class")
    grouped = mine.groupBy("node", "f", "v", "class").agg(F.sum("n").alias("n")).persist()
    each = grouped.groupBy("node", "f", "class").agg(F.sum("n").alias("a"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("m"))
    product = lambda x, y: F.sum(F.col(x) * F.col(y))
    whole = each.groupBy("node", "f").agg(F.sum("a").alias("all_n"), F.sum("m").alias("none_n"), product("a", "a").alias("aa"), product("a", "m").alias("am"), product("m", "m").alias("mm"))
    stats = ["n", "ll", "al", "ml"]

    def sides(missing_left: bool) -> tuple[Column, Column, Column]:
        n, ll, al = F.col("run_n"), F.col("run_ll"), F.col("run_al")
        if missing_left:
            n, ll, al = n + F.col("none_n"), ll + 2 * F.col("run_ml") + F.col("mm"), al + F.col("am")
        rest = F.col("all_n") - n
        return n, rest, ll / n + (F.col("aa") - 2 * al + ll) / rest - F.col("aa") / F.col("all_n")

    try:
        with running(grouped.where("v is not null"), ["node", "f", "class"], "v", ["n"]) as counted:
            own = counted.join(each, ["node", "f", "class"])
            growth = own.select("node", "f", "v", "n", (F.col("n") * (2 * F.col("run_n") - F.col("n"))).alias("ll"), (F.col("n") * F.col("a")).alias("al"), (F.col("n") * F.col("m")).alias("ml"))
            with running(growth.groupBy("node", "f", "v").agg(*(F.sum(s).alias(s) for s in stats)), ["node", "f"], "v", stats) as ordered:
                return _best(ordered.where("next_value is not null").join(whole, ["node", "f"]), sides, floor)
    finally:
        grouped.unpersist()


def grow(rows: DataFrame, features: int, sums: Sequence[str], floor: int, max_depth: int) -> Tree:
    """A tree over ``rows`` (x0 .., n, sums), or without sums over (x0 .., n, class)."""
    tree, open_nodes = Tree(), [1]
    for _ in range(max_depth):
        if not open_nodes:
            break
        told = rows.withColumn("node", tree.node())
        found = best_splits(told, features, sums, floor, open_nodes) if sums else best_class_splits(told, features, floor, open_nodes)
        tree.splits.update(found)
        open_nodes = [child for n in found for child in (2 * n, 2 * n + 1)]
    return tree


def _path(tree: Tree, coders: Sequence[Encoder], labels: dict[int, list[str | None]], leaf: int) -> list[Predicate]:
    found = []
    for depth in range(leaf.bit_length() - 1, 0, -1):
        node, child = leaf >> depth, leaf >> (depth - 1)
        split, left = tree.splits[node], child % 2 == 0
        coder = coders[split.feature]
        if coder.codes is None:
            found.append(Predicate(variable=coder.column, operator="<=" if left else ">", value=round(split.threshold, THRESHOLD_PLACES), nulls=split.missing and split.missing_left == left))
        else:
            side = [x for i, x in enumerate(labels[split.feature]) if (i <= split.threshold) == left]
            found.append(Predicate(variable=coder.column, operator="in", value=set(side) - {None}, nulls=None in side))
    return simplify(found)


def leaf_floor(rows: int, user: int) -> int:
    return max(user, LEAF_FLOOR, int(LEAF_SHARE * rows))


def analyze(frame: DataFrame, features: Sequence[str] | None, target: str, *, task: str | None = None, max_depth: int = MAX_DEPTH, min_samples_leaf: int = LEAF_FLOOR) -> DecisionTreeResult:
    """Fit a tree that predicts ``target`` and tell it as rules. Input at fault raises ValueError."""
    if task not in (None, "auto", "classification", "regression"):
        raise ValueError(f"task must be classification, regression, auto or None, not {task!r}")
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be 1 to {MAX_DEPTH}")
    if min_samples_leaf < 1:
        raise ValueError("min_samples_leaf must be at least 1")
    if target not in frame.columns:
        raise ValueError(f"target column {target!r} is not found; columns: {', '.join(frame.columns)}")
    columns = [c for c in frame.columns if c != target] if features is None else list(dict.fromkeys(features))
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"feature columns are not found: {', '.join(missing)}")
    if target in columns:
        raise ValueError(f"target column {target!r} cannot be a feature too")
    y = named(target)
    row = frame.agg(F.count(y).alias("n"), F.count_distinct(y).alias("u")).first()
    if not row["n"]:
        raise ValueError(f"target column {target!r} contains only null values")
    if row["u"] <= 1:
        raise ValueError(f"target column {target!r} must have more than one unique value")
    if row["n"] < min_samples_leaf:
        raise ValueError(f"only {row['n']} rows have a target, but min_samples_leaf is {min_samples_leaf}")
    clean = frame.where(y.isNotNull())
    kept, excluded = filter_features(clean, columns)
    if not kept:
        raise ValueError("No valid feature columns: " + ("; ".join(f"{c}: {why}" for c, why in excluded.items()) or "none are given"))
    task = infer_task(clean, target, task)
    coders = encoders(clean, kept)
    n, floor = row["n"], leaf_floor(row["n"], min_samples_leaf)
    encoded = encode(clean, coders)
    xs = [F.col(f"x{i}") for i in range(len(coders))]
    labels: list = []
    if task == "classification":
        if row["u"] <= CLASS_COLUMNS:
            labels = [r[0] for r in clean.select(y.alias("y")).distinct().orderBy("y").collect()]
            sums = [f"c{k}" for k in range(len(labels))]
            values = [(y == F.lit(label)).cast("long").alias(s) for s, label in zip(sums, labels)]
        else:
            sums, values = [], [y.alias("class")]
    else:
        number = as_number(y, clean.schema[target].dataType)
        if number is None:
            raise ValueError(f"target column {target!r} cannot be converted to float for regression")
        mean = clean.agg(F.avg(number)).first()[0]
        sums, values = ["c0"], [(number - F.lit(mean)).alias("c0")]
    rows = encoded.select(*xs, F.lit(1).cast("long").alias("n"), *values).persist()
    try:
        tree = grow(rows, len(coders), sums, floor, max_depth)
        placed = rows.withColumn("node", tree.node())
        if sums:
            leaf_aggs = [F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums), F.stddev_pop("c0").alias("std")]
            leaves = {r["node"]: r for r in placed.groupBy("node").agg(*leaf_aggs).collect()}
            spread = rows.agg(F.stddev_pop("c0")).first()[0]
        else:
            counted = placed.groupBy("node", "class").agg(F.sum("n").alias("k"))
            leaves = {r["node"]: r for r in counted.groupBy("node").agg(F.sum("k").alias("n"), F.min(F.struct(-F.col("k"), "class")).alias("top")).collect()}
    finally:
        rows.unpersist()
    names = {f: coders[f].labels() for f in sorted({s.feature for s in tree.splits.values()}) if coders[f].codes is not None}
    for coder in coders:
        if coder.codes is not None:
            coder.codes.unpersist()
    rules: list = []
    right = lost = 0.0
    for leaf in tree.leaves():
        got, path = leaves[leaf], _path(tree, coders, names, leaf)
        if task == "classification":
            if sums:
                top = max(range(len(sums)), key=lambda k: (got[sums[k]], -k))
                most, label = got[sums[top]], labels[top]
            else:
                most, label = -got["top"][0], got["top"][1]
            right += most
            rules.append(ClassificationRule(predicates=path, prediction=str(label), samples=got["n"], confidence=most / got["n"]))
        else:
            lost += got["n"] * got["std"] ** 2
            rules.append(RegressionRule(predicates=path, prediction=got["c0"] / got["n"] + mean, samples=got["n"], std=got["std"]))
    metrics = {"accuracy": right / n} if task == "classification" else {"r_squared": 1 - lost / (n * spread**2) if spread else 0.0, "rmse": (lost / n) ** 0.5}
    gains: dict[str, float] = {c.column: 0.0 for c in coders}
    for s in tree.splits.values():
        gains[coders[s.feature].column] += s.gain
    shares = importances(gains)
    return DecisionTreeResult(task=task, features=list(shares), target=target, rules=rules, feature_importances=shares, metrics=metrics, sample_count=n, depth=tree.depth, leaf_count=len(rules), excluded=excluded)
