"""Column helpers for names with spaces, slashes and parentheses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def c(name: str) -> Column:
    """Reference a column whose name may contain special characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def lag_name(name: str, lag: int = 1) -> str:
    """``X`` -> ``X (t-1)``."""
    return f"{name} (t-{lag})"


def neighbour_name(name: str) -> str:
    """``X`` -> ``X_neighbours``."""
    return f"{name}_neighbours"
