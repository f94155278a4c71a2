"""Names for helper columns that no user column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores before it as make it differ from every column (in any case)."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
