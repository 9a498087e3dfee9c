"""Names for helper columns that no caller's column has."""

from __future__ import annotations

from collections.abc import Iterable


def spare(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many ``_`` before it as it takes to differ (in any case) from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
