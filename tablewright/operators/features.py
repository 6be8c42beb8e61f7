"""Which columns can be features, what a target asks for, and columns as ordered numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_number, is_instant, is_numeric, named
from tablewright.operators.order import running

#: Fixed values.
MOST_DISTINCT_SHARE = 0.9
CLASSES_AT_MOST = 20
CLASSES_BELOW_SHARE = 0.05


def kind_of(kind: T.DataType) -> str:
    """numeric, boolean, categorical, datetime, duration or excluded."""
    if is_numeric(kind):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.StringType):
        return "categorical"
    if is_instant(kind):
        return "datetime"
    return "duration" if isinstance(kind, T.DayTimeIntervalType) else "excluded"


def filter_features(frame: DataFrame, columns: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Columns that can be split on, and why the others can't; one job for all."""
    kinds = {c: kind_of(frame.schema[c].dataType) for c in columns}
    usable = [c for c in columns if kinds[c] != "excluded"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(usable):
        aggs += [F.count(named(c)).alias(f"c{i}"), F.count_distinct(named(c)).alias(f"u{i}")]
    row = frame.agg(*aggs).first()
    excluded = {c: "a type that cannot be split on" for c in columns if kinds[c] == "excluded"}
    for i, c in enumerate(usable):
        unique = row[f"u{i}"] + (row[f"c{i}"] < row["n"])
        if not row[f"c{i}"]:
            excluded[c] = "no value in any row"
        elif unique <= 1:
            excluded[c] = "the same in every row"
        elif kinds[c] == "categorical" and unique / row["n"] > MOST_DISTINCT_SHARE:
            excluded[c] = "over nine tenths of the rows have a label of their own"
    return [c for c in columns if c not in excluded], {c: excluded[c] for c in columns if c in excluded}


def infer_task(frame: DataFrame, target: str, override: str | None = None) -> str:
    """classification or regression: texts and booleans are classes, integers if they have few values."""
    if override in ("classification", "regression"):
        return override
    kind = frame.schema[target].dataType
    if kind_of(kind) in ("boolean", "categorical"):
        return "classification"
    if isinstance(kind, T.IntegralType):
        row = frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(named(target)).alias("u")).first()
        if row["n"] and (row["u"] <= CLASSES_AT_MOST or row["u"] / row["n"] < CLASSES_BELOW_SHARE):
            return "classification"
    return "regression"


@dataclass
class Encoder:
    """A feature as a double: labels by their place in order, null labels last; other nulls stay null.

    ``codes`` are the rows (label, code) of a feature of labels.
    """

    column: str
    codes: DataFrame | None = None

    def labels(self) -> list[str | None]:
        """All labels in order, null last, for rules that name them."""
        return [r["label"] for r in self.codes.orderBy("code").collect()]


def encoders(frame: DataFrame, columns: Sequence[str]) -> list[Encoder]:
    found = []
    for c in columns:
        if kind_of(frame.schema[c].dataType) != "categorical":
            found.append(Encoder(c))
            continue
        distinct = frame.select(named(c).alias("label")).distinct()
        some = distinct.where("label is not null")
        with running(some.select(F.lit(0).alias("all"), "label", F.lit(1).cast("long").alias("one")), ["all"], "label", ["one"]) as ranks:
            codes = ranks.select("label", (F.col("run_one") - 1).cast("double").alias("code"))
            if not distinct.where("label is null").isEmpty():
                codes = codes.unionAll(some.agg(F.lit(None).cast("string").alias("label"), F.count(F.lit(1)).cast("double").alias("code")))
            codes = codes.persist()
            codes.count()  # before the ranks are released
        found.append(Encoder(c, codes))
    return found


def encode(frame: DataFrame, coders: Sequence[Encoder]) -> DataFrame:
    """``frame`` with columns x0, x1, ... for the features; labels meet their codes in a join."""
    out = frame
    for i, coder in enumerate(coders):
        if coder.codes is None:
            out = out.withColumn(f"x{i}", as_number(named(coder.column), frame.schema[coder.column].dataType))
            continue
        codes = coder.codes.select(F.col("label").alias(f"l{i}"), F.col("code").alias(f"x{i}"))
        out = out.join(codes, named(coder.column).eqNullSafe(F.col(f"l{i}")), "left").drop(f"l{i}")
    return out
