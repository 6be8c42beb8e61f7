"""Previews: first and last rows, or an exact sample, in the order of registration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import named
from tablewright.functions.markdown import markdown
from tablewright.sources.registry import ROW, Snapshot

DEFAULT_ROWS = 10


def check_columns(columns: Sequence[str], available: Sequence[str]) -> None:
    if not columns:
        raise ValueError("columns must not be empty")
    if twice := sorted({c for c in columns if list(columns).count(c) > 1}):
        raise ValueError(f"columns are listed twice: {', '.join(twice)}")
    if missing := [c for c in columns if c not in available]:
        raise ValueError(f"no such columns: {', '.join(missing)}; available: {', '.join(available)}")


def sample(numbered: DataFrame, rows: int, seed: int | None = None) -> DataFrame:
    """Exactly ``rows`` rows (all, if there are fewer), the same ones for the same seed."""
    key = F.rand() if seed is None else F.xxhash64(F.col(ROW), F.lit(seed))
    return numbered.orderBy(key, ROW).limit(rows)


def preview(table: Snapshot, columns: Sequence[str] | None = None, num_rows: int = DEFAULT_ROWS, sampled: bool = False, seed: int | None = None) -> str:
    if num_rows < 1:
        raise ValueError("num_rows must be at least 1")
    if seed is not None and not sampled:
        raise ValueError("a seed needs sample=True")
    names = list(table.frame.columns) if columns is None else list(columns)
    if columns is not None:
        check_columns(names, table.frame.columns)
    shown = table.numbered.select(*map(named, names), named(ROW))
    cut = lambda rows: [list(r)[:-1] for r in rows]
    if sampled:
        return markdown(names, cut(sample(shown, num_rows, seed).orderBy(ROW).collect()))
    # Row numbers grow with the partitions: taking reads the first partitions only, or the last.
    first = shown.take(num_rows + 1)
    if len(first) <= num_rows:
        return markdown(names, cut(first))
    half = num_rows // 2
    return markdown(names, [*cut(first[: num_rows - half]), ["…"] * len(names), *cut(shown.tail(half) if half else [])])
