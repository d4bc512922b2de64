"""Platform usage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators.ranking import peak_per_group, top_rows
from playtrail.operators.rollup import rollup
from playtrail.params import DEFAULTS, PlayParams
from playtrail.plans.rollups import platform_stats


def platform_preferences(stats: DataFrame) -> DataFrame:
    """Strongest platform category of each content type."""
    return peak_per_group(stats, ["content_type"], "listening_hours", ["platform_category"]).select(
        "content_type", "platform_category"
    )


def platform_evolution(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["year", "platform_category"])


def platform_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.countDistinct("platform_category").alias("total_platforms"))


def most_used_platform(stats: DataFrame) -> DataFrame:
    """Platform of the single strongest (platform, content type) cell."""
    return top_rows(stats, "listening_hours", 1, ["platform_category", "content_type"]).select(
        "platform_category", "listening_hours"
    )


def analyze_platform_usage(
    cube: DataFrame,
    sessions: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame],
    params: PlayParams = DEFAULTS,
) -> dict[str, DataFrame]:
    """All platform results from the class (or play) and session cubes; ``keep`` stores a table that
    several results start from."""
    stats = keep(platform_stats(cube, sessions, params.session_key), "platform_stats")
    return {
        "platform_stats": stats,
        "platform_preferences": platform_preferences(stats),
        "platform_evolution": platform_evolution(cube),
        "total_platforms": platform_totals(stats),
        "most_used_platform": most_used_platform(stats),
    }
