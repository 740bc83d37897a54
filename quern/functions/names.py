"""Column names that don't clash with those of an input."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, or the name with underscores after it, that no column has."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name inside an expression."""
    return "`" + name.replace("`", "``") + "`"
