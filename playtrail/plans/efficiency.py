"""How completely plays are listened to, and how often they are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.nulls import ratio
from playtrail.operators.medians import exact_median
from playtrail.operators.ranking import top_rows
from playtrail.operators.rollup import EFFICIENCY, mean, measure, rollup
from playtrail.params import DEFAULTS, PlayParams


def efficiency_stats(plays: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    stats = plays.groupBy("content_type").agg(
        F.avg(EFFICIENCY).alias("avg_efficiency"),
        F.stddev_samp(EFFICIENCY).alias("std_efficiency"),
        F.count_if("is_skip").alias("total_skips"),
        F.count_if("is_complete_listen").alias("total_completes"),
        F.count("track_name").alias("total_tracks"),
    )
    median = exact_median(
        plays, ["content_type"], EFFICIENCY, "median_efficiency", params.median_accuracy
    )
    tracks = F.col("total_tracks")
    return stats.join(median, "content_type", "left").withColumns(
        {
            "skip_rate": ratio(F.col("total_skips"), tracks),
            "completion_rate": ratio(F.col("total_completes"), tracks),
        }
    )


def time_efficiency(plays: DataFrame) -> DataFrame:
    return rollup(
        plays,
        ["time_of_day", "content_type"],
        ("skips", "plays"),
        [EFFICIENCY],
        dense="time_of_day",
    )


def feature_efficiency(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["mood"], ("skips", "plays"), [EFFICIENCY])


def artist_efficiency(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["artist_name"], ("skips", "plays", "ms_played"), [EFFICIENCY])


def top_efficient_artists(artists: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(artists, EFFICIENCY, n, ["artist_name"])


def bottom_efficient_artists(artists: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(artists, EFFICIENCY, n, ["artist_name"], largest=False)


def overall_efficiency(plays: DataFrame) -> DataFrame:
    summed = plays.agg(mean(plays, EFFICIENCY), measure(plays, "skips"), measure(plays, "n_rows"))
    return summed.select(
        F.col(EFFICIENCY).alias("overall_efficiency"),
        ratio(F.col("skips"), F.col("n_rows")).alias("overall_skip_rate"),
    )


def analyze_listening_efficiency(
    cube: DataFrame,
    names: DataFrame,
    enriched: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame],
    params: PlayParams = DEFAULTS,
) -> dict[str, DataFrame]:
    """All efficiency results; only the spread per content type reads single plays."""
    artists = keep(artist_efficiency(names), "artists")
    return {
        "efficiency_stats": efficiency_stats(enriched, params),
        "time_efficiency": time_efficiency(cube),
        "feature_efficiency": feature_efficiency(cube),
        "artist_efficiency": artists,
        "top_efficient_artists": top_efficient_artists(artists),
        "bottom_efficient_artists": bottom_efficient_artists(artists),
        "overall": overall_efficiency(cube),
    }
