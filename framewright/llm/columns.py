"""Names for working columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], base: str) -> str:
    """``base``, or with underscores before it until it clashes with none (Spark ignores case)."""
    have = {name.lower() for name in taken}
    while base.lower() in have:
        base = f"_{base}"
    return base
