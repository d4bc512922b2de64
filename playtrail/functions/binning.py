"""SQL text for right-closed bins and labelled levels, and adding many columns at once.

Row-level columns are SQL expressions: Spark compiles them into the scan's stage either
way, and one string costs one call from Python where a Column tree costs dozens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def bin_ordinal(value: str, edges: Sequence[float]) -> str:
    """0-based bin index; the lowest edge belongs to the first bin, outside is null."""
    steps = " ".join(f"WHEN {value} <= {upper} THEN {i}" for i, upper in enumerate(edges[1:]))
    return f"CASE WHEN {value} < {edges[0]} THEN NULL {steps} END"


def level_name(ordinal: str, levels: Sequence[str]) -> str:
    """Label of an ordinal; null and out-of-range ordinals stay null."""
    steps = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(levels))
    return f"CASE {ordinal} {steps} END"


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns given as SQL text, or replace those already there."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{text} AS {name}" for name, text in columns.items()])
