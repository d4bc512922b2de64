"""Plain-language sentences over analysis results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.plans import texts

INSIGHTS_SCHEMA = "category string, ord int, insight string"


def _lines(source: DataFrame, category: str, first: int, *texts: Column) -> DataFrame:
    """One sentence per text over a one-row frame, which is computed once."""
    numbered = source.select(F.posexplode(F.array(*texts)).alias("ord", "insight"))
    return numbered.selectExpr(f"'{category}' AS category", f"ord + {first} AS ord", "insight")


def temporal_insights(results: dict[str, DataFrame]) -> list[DataFrame]:
    category = "temporal_insights"
    day = F.format_string(
        texts.PEAK_DAY, "day_of_week", "listening_hours"
    )
    season = F.format_string(texts.FAVORITE_SEASON, "season")
    time = F.format_string(texts.PEAK_TIME, "time_of_day")
    return [
        _lines(results["peak_day"], category, 1, day),
        _lines(results["favorite_season"], category, 2, season),
        _lines(results["favorite_time"], category, 3, time),
    ]


def session_insights(results: dict[str, DataFrame]) -> list[DataFrame]:
    category = "session_insights"
    length = F.format_string(
        texts.SESSION_LENGTH, "average_session_duration"
    )
    binges = F.format_string(texts.BINGES, "count", "percentage")
    return [
        _lines(results["session_totals"], category, 1, length),
        _lines(results["binge_sessions"], category, 2, binges),
    ]


def platform_insights(results: dict[str, DataFrame]) -> list[DataFrame]:
    text = F.format_string(texts.TOP_PLATFORM, "platform_category")
    return [_lines(results["most_used_platform"], "platform_insights", 1, text)]


def efficiency_insights(results: dict[str, DataFrame]) -> list[DataFrame]:
    efficiency = F.format_string(
        texts.EFFICIENCY, F.col("overall_efficiency") * 100
    )
    skips = F.format_string(texts.SKIP_RATE, F.col("overall_skip_rate") * 100)
    return [_lines(results["overall"], "efficiency_insights", 1, efficiency, skips)]


# Which analysis feeds which sentences.
BUILDERS = {
    "temporal_patterns": temporal_insights,
    "session_behavior": session_insights,
    "platform_usage": platform_insights,
    "listening_efficiency": efficiency_insights,
}


def generate_insights(
    results: dict[str, dict[str, DataFrame]], spark: SparkSession | None = None
) -> DataFrame:
    """Rows ``(category, ord, insight)`` for the analyses present in ``results``; none of
    them gives no rows."""
    lines = [
        line for name, build in BUILDERS.items() if name in results for line in build(results[name])
    ]
    if not lines:
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame([], INSIGHTS_SCHEMA)
    return reduce(DataFrame.union, lines)
