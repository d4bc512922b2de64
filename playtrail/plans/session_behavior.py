"""What sessions look like: per session, per content type, binges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.nulls import minutes, ratio
from playtrail.operators.medians import column_medians
from playtrail.operators.sessions import session_slots
from playtrail.params import DEFAULTS, PlayParams

_MEANS = ("valence", "energy", "danceability")


def session_stats(plays: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    """One row per session, straight from the slots: the plays are read once and never joined."""
    keys = list(params.keys)
    parts = {
        "n_rows": F.count(F.lit(1)),
        "ms": F.sum("ms_played"),
        "tracks": F.count("track_name"),
        "skips": F.count_if("is_skip"),
        "completes": F.count_if("is_complete_listen"),
        **{f"{c}__sum": F.sum(c) for c in _MEANS},
        **{f"{c}__n": F.count(c) for c in _MEANS},
    }
    sessions = (
        session_slots(plays, params, parts)
        .groupBy(*keys, "session_id")
        .agg(
            F.coalesce(F.sum("ms"), F.lit(0)).alias("session_duration"),
            F.sum("tracks").alias("tracks_in_session"),
            F.sum("n_rows").alias("n_rows"),
            F.timestamp_micros(F.min("first_us")).alias("session_start"),
            F.timestamp_micros(F.max("last_us")).alias("session_end"),
            *[ratio(F.sum(f"{c}__sum"), F.sum(f"{c}__n")).alias(f"avg_{c}") for c in _MEANS],
            F.sum("skips").alias("skips"),
            F.sum("completes").alias("completes"),
        )
    )
    tracks = F.col("tracks_in_session")
    return sessions.withColumns(
        {
            "session_duration_minutes": minutes(F.col("session_duration")),
            "skip_rate": ratio(F.col("skips"), tracks),
            "completion_rate": ratio(F.col("completes"), tracks),
        }
    )


def session_patterns(sessions: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    """Spread of session length and size per content type, with exact medians."""
    length, size = "session_duration_minutes", "tracks_in_session"
    spread = sessions.groupBy("content_type").agg(
        F.avg(length).alias("minutes_mean"),
        F.stddev_samp(length).alias("minutes_std"),
        F.min(length).alias("minutes_min"),
        F.max(length).alias("minutes_max"),
        F.avg(size).alias("tracks_mean"),
        F.stddev_samp(size).alias("tracks_std"),
        F.avg("skip_rate").alias("skip_rate"),
        F.avg("completion_rate").alias("completion_rate"),
    )
    medians = column_medians(sessions, [length, size], params.median_accuracy, ["content_type"])
    middle = medians.groupBy("content_type").agg(
        *[
            F.max(F.when(F.col("feature") == column, F.col("median"))).alias(name)
            for column, name in ((length, "minutes_median"), (size, "tracks_median"))
        ]
    )
    return spread.join(middle, "content_type", "left")


def binge_sessions(sessions: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    """Sessions longer than an hour: how many, what share, how long."""
    length = F.col("session_duration_minutes")
    binge = length > params.binge_minutes
    return sessions.agg(
        F.count_if(binge).alias("count"),
        (ratio(F.count_if(binge), F.count(F.lit(1))) * 100).alias("percentage"),
        F.avg(F.when(binge, length)).alias("average_duration"),
    )


def session_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg("session_duration_minutes").alias("average_session_duration"),
    )
