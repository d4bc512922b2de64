"""Rollups and the summary document written next to the enriched plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.binning import derive
from playtrail.functions.nulls import hours, ratio
from playtrail.functions.temporal import calendar_columns
from playtrail.operators.ranking import top_rows
from playtrail.operators.rollup import (
    EFFICIENCY,
    count_distinct,
    is_cube,
    mean,
    measure,
    name_cube,
    play_cube,
    rollup,
)
from playtrail.params import DEFAULTS
from playtrail.schema import AUDIO_MEANS

_NAMES = {"unique_artists": "artist_name", "unique_albums": "album_name"}
_ALL = ("ms_played", "plays", "completes", "skips")

WEEK = ["year", "week_of_year", "content_type"]
MONTH = ["year", "month", "content_type"]
SESSION_KEY = DEFAULTS.session_key


def daily_stats(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["date", "content_type"], _ALL, [EFFICIENCY, *AUDIO_MEANS])


def weekly_stats(plays: DataFrame) -> DataFrame:
    """By calendar year and ISO week, so the last days of December can be week 1."""
    return rollup(plays, WEEK, means=AUDIO_MEANS, distinct=_NAMES)


def session_cube(plays: DataFrame, session_key: tuple[str, ...] = SESSION_KEY) -> DataFrame:
    """Which sessions touch which day and platform: all that session counts need."""
    grain = ["date", "content_type", "platform_category", *session_key]
    cube = plays.dropna(subset=["session_id"]).groupBy(*grain).agg(measure(plays, "n_rows"))
    days = calendar_columns("date")
    return derive(cube, {k: days[k] for k in ("year", "month", "week_of_year")})


def _counting_sessions(
    plays: DataFrame,
    keys: list[str],
    sessions: DataFrame | None,
    session_key: tuple[str, ...],
    **spec,
) -> DataFrame:
    """A rollup plus distinct sessions per group.

    Two aggregates of small tables, a cube of the plays and a session cube, are joined on
    the group keys: no play is multiplied for the sake of a distinct count.  Given plays
    alone, both cubes are made first, unless sessions are all that is counted.
    """
    if sessions is None and not is_cube(plays) and "distinct" not in spec:
        return rollup(plays, keys, distinct={"total_sessions": session_key}, **spec)
    if sessions is None:
        sessions = session_cube(plays, session_key)
        if not is_cube(plays):
            plays = name_cube(plays) if "distinct" in spec else play_cube(plays)
    counted = (
        sessions.dropna(subset=keys)
        .groupBy(*keys)
        .agg(count_distinct("total_sessions", session_key))
    )
    joined = rollup(plays, keys, **spec).join(counted, keys, "left")
    return joined.withColumn("total_sessions", F.coalesce("total_sessions", F.lit(0)))


def weekly_stats_with_sessions(
    plays: DataFrame,
    sessions: DataFrame | None = None,
    session_key: tuple[str, ...] = SESSION_KEY,
) -> DataFrame:
    return _counting_sessions(
        plays, WEEK, sessions, session_key, means=AUDIO_MEANS, distinct=_NAMES
    )


def monthly_stats(
    plays: DataFrame,
    sessions: DataFrame | None = None,
    session_key: tuple[str, ...] = SESSION_KEY,
) -> DataFrame:
    return _counting_sessions(
        plays, MONTH, sessions, session_key, means=AUDIO_MEANS, distinct=_NAMES
    )


def platform_stats(
    plays: DataFrame,
    sessions: DataFrame | None = None,
    session_key: tuple[str, ...] = SESSION_KEY,
) -> DataFrame:
    return _counting_sessions(
        plays,
        ["platform_category", "content_type"],
        sessions,
        session_key,
        measures=("ms_played", "plays", "skips", "completes"),
        means=("valence", "energy", "danceability"),
    )


def artist_stats(plays: DataFrame) -> DataFrame:
    return rollup(
        plays,
        ["artist_name"],
        _ALL,
        [*AUDIO_MEANS, EFFICIENCY],
        {"unique_albums": "album_name"},
    )


def time_stats(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["time_of_day", "content_type"], means=AUDIO_MEANS, dense="time_of_day")


# --- summary document -------------------------------------------------------------


def value_counts(plays: DataFrame, column: str) -> DataFrame:
    """Plays per value, most frequent first."""
    counted = plays.dropna(subset=[column]).groupBy(column).agg(measure(plays, "n_rows"))
    return counted.withColumnRenamed("n_rows", "n").orderBy(F.desc("n"), column)


def dataset_overview(plays: DataFrame) -> DataFrame:
    """Three distinct counts, on the distinct combinations of names and not on every play."""
    names = plays.groupBy("track_name", "artist_name", "album_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )
    return names.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.countDistinct("track_name").alias("unique_tracks"),
        F.countDistinct("artist_name").alias("unique_artists"),
        F.countDistinct("album_name").alias("unique_albums"),
    )


def listening_behavior(plays: DataFrame, sessions: DataFrame) -> DataFrame:
    """Totals; the session length is averaged per play, so long sessions weigh more.

    That mean comes from the session table weighted by its row counts, which spares
    joining sessions back to the plays.
    """
    per_play = sessions.agg(
        ratio(
            F.sum(F.col("session_duration_minutes") * F.col("n_rows")),
            F.sum("n_rows"),
        )
    ).scalar()
    summed = plays.agg(
        measure(plays, "n_rows"),
        measure(plays, "ms_played"),
        measure(plays, "skips"),
        measure(plays, "completes"),
        mean(plays, EFFICIENCY),
    )
    return summed.select(
        hours(F.col("ms_played")).alias("total_listening_hours"),
        per_play.alias("average_session_duration"),
        ratio(F.col("skips"), F.col("n_rows")).alias("skip_rate"),
        ratio(F.col("completes"), F.col("n_rows")).alias("completion_rate"),
        F.col(EFFICIENCY).alias("average_listening_efficiency"),
    )


def audio_features_summary(plays: DataFrame) -> DataFrame:
    return plays.agg(*[mean(plays, c).alias(f"average_{c}") for c in AUDIO_MEANS])


def summary_document(plays: DataFrame, sessions: DataFrame, cube: DataFrame) -> DataFrame:
    """The summary as one nested row, ready for JSON."""

    def one_row(df: DataFrame):
        return df.select(F.struct(*df.columns)).scalar()

    def distribution(column: str):
        counts = value_counts(cube, column)
        return counts.agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(column), F.col("n"))))
        ).scalar()

    overview = one_row(dataset_overview(plays))
    audio = one_row(audio_features_summary(cube))
    return plays.sparkSession.range(1).select(
        F.struct(
            overview["total_records"].alias("total_records"),
            F.struct(overview["start"].alias("start"), overview["end"].alias("end")).alias(
                "date_range"
            ),
            distribution("content_type").alias("content_types"),
            *[overview[f"unique_{x}"].alias(f"unique_{x}") for x in ("tracks", "artists", "albums")],
        ).alias("dataset_overview"),
        one_row(listening_behavior(cube, sessions)).alias("listening_behavior"),
        F.struct(
            *[audio[f"average_{c}"].alias(f"average_{c}") for c in AUDIO_MEANS],
            distribution("mood").alias("mood_distribution"),
        ).alias("audio_features_summary"),
        F.struct(distribution("platform_category").alias("platform_distribution")).alias(
            "platform_usage"
        ),
    )


# --- parse statistics -------------------------------------------------------------


PARSE_COUNTS = (
    "total_records bigint, music_records bigint, podcast_records bigint, audiobook_records bigint, "
    "video_records bigint, start timestamp, end timestamp, errors bigint"
)


def parse_counts() -> list[Column]:
    """Aggregates over parsed elements: plays by class, the time they cover, and rejects."""
    play = F.col("reason").isNull()
    per_class = [
        F.count_if(play & (F.col("content_type") == kind)).alias(f"{kind}_records")
        for kind in ("music", "podcast", "audiobook", "video")
    ]
    return [
        F.count_if(play).alias("total_records"),
        *per_class,
        F.min(F.when(play, F.col("timestamp"))).alias("start"),
        F.max(F.when(play, F.col("timestamp"))).alias("end"),
        F.count_if(~play).alias("errors"),
    ]


def parse_statistics(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Files seen, rows per class, errors and the covered time range, from parsed elements."""
    file_count = files.agg(F.count(F.lit(1))).scalar()
    return elements.agg(*parse_counts()).withColumn("total_files", file_count)


def top_artists_by_plays(plays: DataFrame, n: int = 10) -> DataFrame:
    counted = rollup(plays, ["artist_name"], ["n_rows"]).withColumnRenamed("n_rows", "n")
    return top_rows(counted, "n", n, ["artist_name"])
