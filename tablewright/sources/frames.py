"""What Spark knows about a frame's plan: with ``plans/walk.py``, all that calls into the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame

_SCANS = {"Project", "Filter", "LogicalRelation"}


def is_deterministic(frame: DataFrame) -> bool:
    """Whether the plan gives the same rows whenever it runs."""
    return bool(frame._jdf.queryExecution().analyzed().deterministic())


def is_file_scan(frame: DataFrame) -> bool:
    """Whether the plan only selects columns and rows of one table of files, which keep its rows by themselves."""
    node = frame._jdf.queryExecution().optimizedPlan()
    while True:
        kind = node.getClass().getSimpleName()
        if kind not in _SCANS:
            return False
        if kind == "LogicalRelation":
            return bool(frame._jdf.inputFiles())
        node = node.children().apply(0)
