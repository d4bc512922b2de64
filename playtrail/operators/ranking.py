"""Argmax and top-n with total, deterministic order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_rows(df: DataFrame, measure: str, n: int, ties: Sequence[str], largest: bool = True):
    """The n rows with the largest (smallest) measure; ties resolve by ``ties`` ascending."""
    order = F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure)
    return df.orderBy(order, *ties).limit(n)


def peak_per_group(
    small: DataFrame, group: Sequence[str], measure: str, ties: Sequence[str]
) -> DataFrame:
    """The row with the largest measure in each group of an already aggregated table."""
    order = W.partitionBy(*group).orderBy(F.desc_nulls_last(measure), *ties)
    return (
        small.withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )
