"""Restoring a toolkit from its exported state: bases are verified, derivatives run again and verified too."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from tablewright.functions.nearly import REL_TOL, nearly_equal
from tablewright.operators.profile import profile
from tablewright.plans.errors import QueryError
from tablewright.plans.guard import analyse
from tablewright.sources.models import ColumnSummary, DataFrameReference, DataFrameToolkitState
from tablewright.sources.registry import DataFrameRegistry, Snapshot
from tablewright.sources.together import together

EXACT = ("dtype", "count", "null_count", "unique_count")
NEAR = ("min", "max", "mean", "std", "p25", "p50", "p75")


def differences(actual: ColumnSummary, expected: ColumnSummary, rel_tol: float = REL_TOL) -> dict[str, tuple[object, object]]:
    """Fields that differ, as (actual, expected); descriptions don't count."""
    found = {f: (getattr(actual, f), getattr(expected, f)) for f in EXACT if getattr(actual, f) != getattr(expected, f)}
    return found | {f: (getattr(actual, f), getattr(expected, f)) for f in NEAR if not nearly_equal(getattr(actual, f), getattr(expected, f), rel_tol)}


def verify(frame: DataFrame, reference: DataFrameReference, rel_tol: float = REL_TOL) -> None:
    """ValueError unless the frame has the reference's shape, columns and statistics."""
    name = reference.name
    if list(frame.columns) != reference.column_names:
        raise ValueError(f"columns of {name!r} are {frame.columns}, expected {reference.column_names}")
    summaries, rows = profile(frame)
    if rows != reference.num_rows:
        raise ValueError(f"{name!r} has {rows} rows, expected {reference.num_rows}")
    told = [f"{c}.{f}: {a!r}, expected {e!r}" for c in reference.column_names for f, (a, e) in differences(summaries[c], reference.column_summaries[c], rel_tol).items()]
    if told:
        raise ValueError(f"{name!r} does not match its reference: {'; '.join(told)}")


def dependency_order(references: list[DataFrameReference]) -> list[DataFrameReference]:
    """Parents before children; unknown parents and cycles are ValueErrors."""
    by_id = {r.id: r for r in references}
    if unknown := sorted({p for r in references for p in r.parent_ids if p not in by_id}):
        raise ValueError(f"unknown parents: {', '.join(unknown)}")
    try:
        return [by_id[x] for x in TopologicalSorter({r.id: r.parent_ids for r in references}).static_order()]
    except CycleError as error:
        raise ValueError(f"references depend on each other in a cycle: {' -> '.join(error.args[1])}") from None


def _keys_to_ids(given: Mapping[str, DataFrame], bases: list[DataFrameReference]) -> dict[str, DataFrame]:
    ids = {r.id: r.id for r in bases} | {r.name: r.id for r in bases}
    found: dict[str, DataFrame] = {}
    for key, frame in given.items():
        if key not in ids:
            raise ValueError(f"{key!r} is no base table of the state; expected: {', '.join(r.name for r in bases)}")
        if ids[key] in found:
            raise ValueError(f"{key!r} is given twice, by name and by id")
        found[ids[key]] = frame
    return found


def restore(state: DataFrameToolkitState, base_dataframes: Mapping[str, DataFrame], rel_tol: float = REL_TOL) -> DataFrameRegistry:
    """A registry with the state's tables under their original ids. On failure nothing stays registered."""
    order = dependency_order(state.references)
    bases = [r for r in state.references if r.is_base]
    frames = _keys_to_ids(base_dataframes, bases)
    if missing := [r.name for r in bases if r.id not in frames]:
        raise ValueError(f"base tables are missing: {', '.join(missing)}")
    registry = DataFrameRegistry()
    snapshots: dict[str, Snapshot] = {}
    try:
        for r in bases:
            snapshots[r.id] = Snapshot(frames[r.id])
        together([partial(verify, snapshots[r.id].frame, r, rel_tol) for r in bases])
        for r in bases:
            registry.register(r, snapshots.pop(r.id))
        for r in order:
            if r.is_base:
                continue
            known = {t: x.column_names for t, x in registry.references.items()}
            spark = registry.context.get_dataframe(r.parent_ids[0]).sparkSession
            try:
                frame, _ = analyse(spark, r.source_query or "", known)
            except QueryError as error:
                raise ValueError(f"the query of {r.name!r} cannot be run again: {error.message}") from error
            snapshots[r.id] = Snapshot(frame)
            verify(snapshots[r.id].frame, r, rel_tol)
            registry.register(r, snapshots.pop(r.id))
    except BaseException:
        for kept in snapshots.values():
            kept.release()
        registry.context.clear()
        raise
    return registry
