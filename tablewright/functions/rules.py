"""Predicates, leaf rules and results of a decision tree."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Annotated, Literal

from pydantic import BaseModel, Field, field_validator, model_validator
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_number, named

_TESTS: dict[str, Callable] = {">": operator.gt, ">=": operator.ge, "!=": operator.ne, "==": operator.eq, "<": operator.lt, "<=": operator.le, "in": lambda x, s: x in s, "not in": lambda x, s: x not in s}


class Predicate(BaseModel):
    """A test of one variable: a set for membership, one value for everything else."""

    variable: str
    operator: Literal[">", ">=", "!=", "==", "<", "<=", "in", "not in"]
    value: float | str | set[float] | set[str]
    #: Whether a missing value passes.
    nulls: bool = False

    @model_validator(mode="after")
    def _fits(self) -> Predicate:
        if (self.operator in ("in", "not in")) != isinstance(self.value, set):
            raise ValueError(f"{self.operator!r} does not go with {type(self.value).__name__}")
        return self

    def __str__(self) -> str:
        value = "{" + ", ".join(str(x) for x in sorted(self.value, key=lambda x: (str(type(x)), x))) + "}" if isinstance(self.value, set) else self.value
        return f"{self.variable} {self.operator} {value}" + (" or null" if self.nulls else "")

    def eval(self, x: float | str | None) -> bool:
        return self.nulls if x is None else bool(_TESTS[self.operator](x, self.value))

    def column(self, kind: T.DataType | None = None) -> Column:
        """The same test as a column expression, never null. ``kind`` is the variable's type, where that isn't a number or text."""
        x = named(self.variable)
        if isinstance(self.value, set):
            inside = x.isin(sorted(self.value)) if self.value else x.isNull() & F.lit(False)
            test = inside if self.operator == "in" else ~inside
        else:
            test = _TESTS[self.operator](as_number(x, kind) if kind is not None and not isinstance(self.value, str) else x, F.lit(self.value))
        return F.when(x.isNull(), F.lit(self.nulls)).otherwise(test)


def simplify(predicates: Sequence[Predicate]) -> list[Predicate]:
    """One predicate per variable and operator, in order of first use: least ``<=``, greatest ``>``, common ``in``; a missing value
    passes if it passes all."""
    groups: dict[tuple[str, str], list[Predicate]] = {}
    for p in predicates:
        groups.setdefault((p.variable, p.operator), []).append(p)
    found = []
    for (variable, op), group in groups.items():
        nulls = all(p.nulls for p in group)
        if op in ("<=", ">"):
            value = (min if op == "<=" else max)(p.value for p in group)
        elif op == "in":
            value = reduce(operator.and_, (p.value for p in group))
            if not value and not nulls:
                raise ValueError(f"contradicting sets for {variable!r}")
        else:
            found += group
            continue
        found.append(Predicate(variable=variable, operator=op, value=value, nulls=nulls))
    return found


class ClassificationRule(BaseModel):
    task: Literal["classification"] = "classification"
    predicates: list[Predicate]
    prediction: str | float
    samples: int = Field(ge=1)
    confidence: float = Field(ge=0, le=1)


class RegressionRule(BaseModel):
    task: Literal["regression"] = "regression"
    predicates: list[Predicate]
    prediction: float
    samples: int = Field(ge=1)
    std: float = Field(ge=0)


DecisionTreeRule = Annotated[ClassificationRule | RegressionRule, Field(discriminator="task")]


class DecisionTreeResult(BaseModel):
    """A fitted tree as rules, with importances that sum to one, training metrics and its shape."""

    task: Literal["classification", "regression"]
    features: list[str]
    target: str
    rules: list[DecisionTreeRule]
    feature_importances: dict[str, float]
    metrics: dict[str, float]
    sample_count: int = Field(ge=1)
    depth: int = Field(ge=0)
    leaf_count: int = Field(ge=1)
    excluded: dict[str, str] = Field(default_factory=dict)

    @field_validator("feature_importances")
    @classmethod
    def _sums_to_one(cls, value: dict[str, float]) -> dict[str, float]:
        if value and abs(sum(value.values()) - 1) > 1e-6:
            raise ValueError("importances must sum to 1")
        return value

    @model_validator(mode="after")
    def _agrees(self) -> DecisionTreeResult:
        if set(self.feature_importances) != set(self.features):
            raise ValueError("importances and features name different columns")
        if len(self.rules) != self.leaf_count:
            raise ValueError("there must be a rule for each leaf")
        if any(r.task != self.task for r in self.rules):
            raise ValueError("rules and result are of different tasks")
        return self


def importances(gains: dict[str, float]) -> dict[str, float]:
    """Shares of the gains, rounded to 4 places, largest first; zeros go and the last one takes up the rounding."""
    total = sum(gains.values())
    shares = [(k, round(v / total, 4)) for k, v in gains.items()] if total > 0 else []
    shares = sorted(((k, v) for k, v in shares if v > 0), key=lambda x: -x[1])
    whole = sum(v for _, v in shares)
    shares = [(k, round(v / whole, 4)) for k, v in shares]
    return {k: v if i + 1 < len(shares) else round(1 - sum(x for _, x in shares[:-1]), 4) for i, (k, v) in enumerate(shares)}
