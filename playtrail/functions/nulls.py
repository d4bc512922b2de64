"""Null rules shared by every operator: unknown is never true, x/0 is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(condition: Column) -> Column:
    """A boolean that treats unknown as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of failing on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def hours(ms: Column) -> Column:
    return ms / F.lit(3_600_000)


def minutes(ms: Column) -> Column:
    return ms / F.lit(60_000)
