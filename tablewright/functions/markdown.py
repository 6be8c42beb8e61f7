"""Rows as a markdown table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def cell(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value).replace("|", "\\|").replace("\r\n", " ").replace("\n", " ")


def markdown(columns: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """A header, a rule and a line for each row."""
    lines = [list(map(cell, columns)), ["---"] * len(columns), *([cell(v) for v in row] for row in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
