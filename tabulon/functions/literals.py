"""Python numbers as SQL text."""

from __future__ import annotations


def double(x: float) -> str:
    """A double literal that reads back as the same number."""
    return f"CAST('{float(x)!r}' AS DOUBLE)" if x != x or x in (float("inf"), float("-inf")) else f"{float(x)!r}D"


def quoted(name: str) -> str:
    """A column name in backticks."""
    return "`" + name.replace("`", "``") + "`"


def total(terms: list[str]) -> str:
    """The sum of SQL terms; 0 for none."""
    return " + ".join(terms) if terms else "0.0D"
