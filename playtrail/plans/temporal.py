"""Daily, weekly, monthly, seasonal, time-of-day and yearly patterns.

Each function takes plays (or a cube) or one of the rollups below it; scalars are
one-row DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtrail.functions.nulls import ratio
from playtrail.operators.ranking import peak_per_group, top_rows
from playtrail.operators.rollup import rollup
from playtrail.params import DEFAULTS, PlayParams
from playtrail.plans.rollups import monthly_stats, time_stats, weekly_stats_with_sessions
from playtrail.schema import AUDIO_MEANS

HOURS = "listening_hours"


# --- days -------------------------------------------------------------------------


def daily_pattern_stats(plays: DataFrame) -> DataFrame:
    daily = rollup(
        plays,
        ["date", "content_type"],
        ("ms_played", "plays", "completes", "skips"),
        AUDIO_MEANS,
    )
    return daily.withColumn("day_of_week", F.weekday("date"))


def day_of_week_stats(daily: DataFrame) -> DataFrame:
    """Mean over days, every active day counting the same."""
    columns = [HOURS, "plays", "skip_rate", "completion_rate", "valence", "energy"]
    return daily.groupBy("day_of_week", "content_type").agg(*[F.avg(c).alias(c) for c in columns])


def day_totals(daily: DataFrame) -> DataFrame:
    return daily.agg(F.countDistinct("date").alias("total_days"))


def mean_hours_by_type(period: DataFrame, name: str) -> DataFrame:
    """Mean hours per content type over the periods in which it was active."""
    return period.groupBy("content_type").agg(F.avg(HOURS).alias(name))


def peak_day(by_weekday: DataFrame) -> DataFrame:
    return top_rows(by_weekday, HOURS, 1, ["day_of_week", "content_type"])


# --- weeks and months -------------------------------------------------------------


def period_trends(period: DataFrame) -> DataFrame:
    """Spread of hours and mean variety per content type over weeks or months."""
    return period.groupBy("content_type").agg(
        F.avg(HOURS).alias("hours_mean"),
        F.stddev_samp(HOURS).alias("hours_std"),
        F.min(HOURS).alias("hours_min"),
        F.max(HOURS).alias("hours_max"),
        F.avg("unique_artists").alias("unique_artists_mean"),
        F.avg("total_sessions").alias("total_sessions_mean"),
    )


def distinct_periods(period: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct week, month or year *numbers*."""
    return period.agg(F.countDistinct(column).alias(name))


def peak_months(monthly: DataFrame) -> DataFrame:
    return peak_per_group(monthly, ["content_type"], HOURS, ["year", "month"])


# --- seasons and times of day -----------------------------------------------------


def seasonal_stats(plays: DataFrame) -> DataFrame:
    return rollup(
        plays,
        ["season", "content_type"],
        means=AUDIO_MEANS,
        distinct={"unique_artists": "artist_name"},
        dense="season",
    )


def peak_level(cells: DataFrame, level: str) -> DataFrame:
    """Per content type the row of its strongest season or time of day."""
    return peak_per_group(cells, ["content_type"], HOURS, [f"{level}_ord"])


def level_audio_features(cells: DataFrame, level: str) -> DataFrame:
    """Per level the mean over content types of their means."""
    return cells.groupBy(level, f"{level}_ord").agg(*[F.avg(c).alias(c) for c in AUDIO_MEANS])


def favorite_level(cells: DataFrame, level: str) -> DataFrame:
    """Level of the single strongest (level, content type) cell."""
    return top_rows(cells, HOURS, 1, [f"{level}_ord", "content_type"]).select(level, HOURS)


# --- years ------------------------------------------------------------------------


def yearly_stats(plays: DataFrame) -> DataFrame:
    return rollup(
        plays,
        ["year", "content_type"],
        means=AUDIO_MEANS,
        distinct={"unique_artists": "artist_name", "unique_albums": "album_name"},
    )


def yearly_growth(yearly: DataFrame) -> DataFrame:
    """Change of hours in percent against the previous year that has plays."""
    previous = F.lag(HOURS).over(W.partitionBy("content_type").orderBy("year"))
    change = (ratio(F.col(HOURS), previous) - 1) * 100
    return yearly.withColumn("growth_rate", change)


def overall_trends(yearly: DataFrame) -> DataFrame:
    """Per year; an artist heard in two content types counts twice."""
    return yearly.groupBy("year").agg(
        F.sum(HOURS).alias(HOURS),
        F.sum("unique_artists").alias("unique_artists"),
        F.avg("valence").alias("valence"),
        F.avg("energy").alias("energy"),
    )


def year_totals(growth: DataFrame) -> DataFrame:
    return growth.agg(
        F.countDistinct("year").alias("total_years"), F.avg("growth_rate").alias("growth_rate")
    )


# --- everything -------------------------------------------------------------------


def analyze_temporal_patterns(
    cube: DataFrame,
    classes: DataFrame,
    names: DataFrame,
    sessions: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame],
    params: PlayParams = DEFAULTS,
) -> dict[str, DataFrame]:
    """All temporal results from the play, class, name and session cubes.

    ``keep`` stores a table that several results start from.
    """
    daily = keep(daily_pattern_stats(cube), "daily")
    weekdays = day_of_week_stats(daily)
    weekly = keep(weekly_stats_with_sessions(names, sessions, params.session_key), "weekly")
    monthly = keep(monthly_stats(names, sessions, params.session_key), "monthly")
    seasons = keep(seasonal_stats(names), "seasons")
    times = keep(time_stats(classes), "times")
    yearly = keep(yearly_stats(names), "yearly")
    growth = yearly_growth(yearly)
    return {
        "daily_stats": daily,
        "day_of_week_stats": weekdays,
        "total_days": day_totals(daily),
        "average_daily_hours": mean_hours_by_type(daily, "average_daily_hours"),
        "peak_day": peak_day(weekdays),
        "weekly_stats": weekly,
        "weekly_trends": period_trends(weekly),
        "total_weeks": distinct_periods(weekly, "week_of_year", "total_weeks"),
        "average_weekly_hours": mean_hours_by_type(weekly, "average_weekly_hours"),
        "monthly_stats": monthly,
        "monthly_trends": period_trends(monthly),
        "peak_months": peak_months(monthly),
        "total_months": distinct_periods(monthly, "month", "total_months"),
        "seasonal_stats": seasons,
        "seasonal_preferences": peak_level(seasons, "season").select("content_type", "season"),
        "seasonal_audio_features": level_audio_features(seasons, "season"),
        "favorite_season": favorite_level(seasons, "season"),
        "time_stats": times,
        "peak_times": peak_level(times, "time_of_day"),
        "time_audio_features": level_audio_features(times, "time_of_day"),
        "favorite_time": favorite_level(times, "time_of_day"),
        "yearly_stats": yearly,
        "yearly_growth": growth,
        "overall_trends": overall_trends(yearly),
        "year_totals": year_totals(growth),
    }


def rounded(df: DataFrame, digits: int, skip: Sequence[str] = ()) -> DataFrame:
    """Half-even rounding of the floating-point columns, for display."""
    floats = [n for n, t in df.dtypes if t in ("double", "float") and n not in skip]
    return df.withColumns({c: F.bround(c, digits) for c in floats})
