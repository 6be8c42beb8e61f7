"""Equality of summaries up to rounding."""

from __future__ import annotations

import math

REL_TOL = 1e-9


def nearly_equal(a: float | str | bool | None, b: float | str | bool | None, rel_tol: float = REL_TOL) -> bool:
    """None equals None only, texts and booleans equal themselves, NaN equals NaN, other numbers up to ``rel_tol``."""
    plain = [isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)]
    if not all(plain):
        return not any(plain) and type(a) is type(b) and a == b
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return math.isclose(a, b, rel_tol=rel_tol)
