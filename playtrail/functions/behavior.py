"""Columns describing how a play went: skips, completion, efficiency, platform."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playtrail.functions.binning import derive
from playtrail.params import DEFAULTS, PlayParams
from playtrail.schema import CONTENT_TYPES

# Platform names (lower case) and their category.
PLATFORM_CATEGORIES = {
    "android": "Mobile",
    "ios": "Mobile",
    "web_player": "Web",
    "desktop": "Desktop",
    "unknown": "Unknown",
}


def platform_category(platform: str) -> str:
    steps = " ".join(f"WHEN '{raw}' THEN '{name}'" for raw, name in PLATFORM_CATEGORIES.items())
    return f"CASE lower(coalesce({platform}, 'unknown')) {steps} ELSE 'Other' END"


def add_behavior_features(plays: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    """Needs ``ms_played``, ``skipped``, ``platform``; uses ``duration_ms`` when there."""
    if "duration_ms" in plays.columns:
        share = "try_divide(CAST(ms_played AS DOUBLE), CAST(duration_ms AS DOUBLE))"
        cut_short = f"coalesce({share} < {params.skip_threshold}D, false)"
        efficiency = f"CASE WHEN duration_ms > 0 THEN {share} ELSE 0D END"
    else:
        cut_short = f"coalesce(ms_played < {params.fallback_skip_ms}, false)"
        efficiency = (
            f"CASE WHEN ms_played > 0 THEN least(ms_played / {params.fallback_track_ms}, 1D) "
            "ELSE 0D END"
        )
    long_enough = f"coalesce(ms_played >= {params.min_listening_ms}, false)"
    return derive(
        plays,
        {
            "listening_duration_minutes": "ms_played / 60000",
            "is_skip": "coalesce(skipped, false)",
            "skip_by_duration": cut_short,
            "is_complete_listen": f"{long_enough} AND NOT {cut_short}",
            "listening_efficiency": efficiency,
            "platform_category": platform_category("platform"),
        },
    )


def add_content_flags(plays: DataFrame) -> DataFrame:
    flags = {f"is_{kind}": f"coalesce(content_type = '{kind}', false)" for kind in CONTENT_TYPES}
    return derive(plays, {**flags, "content_duration_hours": "ms_played / 3600000"})
