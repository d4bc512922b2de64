"""Calendar columns of a play (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playtrail.functions.binning import bin_ordinal, derive, level_name
from playtrail.schema import HOUR_EDGES, MONTH_EDGES, SEASONS, TIME_OF_DAY, WEEKDAYS


def calendar_columns(ts: str) -> dict[str, str]:
    """Everything that follows from the calendar date alone."""
    season = bin_ordinal(f"month({ts})", MONTH_EDGES)
    day_name = level_name(f"weekday({ts})", WEEKDAYS)
    return {
        "date": f"to_date({ts})",
        "year": f"year({ts})",
        "month": f"month({ts})",
        "day": f"day({ts})",
        "day_of_week": f"weekday({ts})",
        "day_of_year": f"dayofyear({ts})",
        "week_of_year": f"weekofyear({ts})",
        "quarter": f"quarter({ts})",
        "day_type": f"CASE WHEN weekday({ts}) >= 5 THEN 'Weekend' ELSE {day_name} END",
        "season_ord": season,
        "season": level_name(season, SEASONS),
    }


def clock_columns(hour: str) -> dict[str, str]:
    """Everything that follows from the hour of the day."""
    ordinal = bin_ordinal(hour, HOUR_EDGES)
    return {"time_of_day_ord": ordinal, "time_of_day": level_name(ordinal, TIME_OF_DAY)}


def add_temporal_features(plays: DataFrame) -> DataFrame:
    columns = calendar_columns("timestamp")
    return derive(
        plays, {**columns, "hour": "hour(timestamp)", **clock_columns("hour(timestamp)")}
    )


def weekday_name(day_of_week: str) -> str:
    return level_name(day_of_week, WEEKDAYS)
