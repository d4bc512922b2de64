"""Cleaning, feature join, derived columns and sessions, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import base
from checks.adapters import EVENTS_SQL, FEATURES_SQL, ORDERS_SQL, audio_features
from checks.adapters import plays_from_events, plays_from_orders
from checks.base import filled_sql, rows, rows_sql, sessions_sql, with_sql
from checks.registry import big, check, r, rounded
from playtrail.functions.audio import add_audio_features, add_default_features
from playtrail.functions.behavior import add_behavior_features, add_content_flags
from playtrail.functions.temporal import add_temporal_features
from playtrail.operators import cleaning, joins, medians, sessions
from playtrail.params import PlayParams
from playtrail.plans.enrich import enrich
from playtrail.schema import AUDIO_MEASURES
from playtrail.session import materialize

FEATURES = (
    "danceability",
    "energy",
    "valence",
    "acousticness",
    "instrumentalness",
    "speechiness",
    "liveness",
    "tempo",
    "duration_ms",
)
TEMPORAL = (
    "date year month day hour day_of_week day_of_year week_of_year quarter "
    "time_of_day day_type season"
).split()
BEHAVIOR = (
    "listening_duration_minutes is_skip skip_by_duration is_complete_listen "
    "listening_efficiency platform_category"
).split()
AUDIO = (
    "mood energy_level danceability_level tempo_category musical_complexity inferred_genre"
).split()
FLAGS = "is_music is_podcast is_audiobook is_video content_duration_hours".split()
SESSION = (
    "session_id session_duration tracks_in_session session_start session_end "
    "session_duration_minutes"
).split()


def commas(*names: str) -> str:
    return ", ".join(names)


# --- join and cleaning ------------------------------------------------------------


@check(
    "feature_join",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        select=f"""SELECT p.play_id, p.track_uri, f.track_id, {commas(*FEATURES)}, f.key, f.mode
FROM plays_events p LEFT JOIN features f ON p.track_uri = f.track_id""",
    ),
)
def feature_join(spark, sf):
    joined = joins.join_audio_features(plays_from_events(spark, sf), audio_features(spark, sf))
    return joined.select("play_id", "track_uri", "track_id", *FEATURES, "key", "mode")


@check(
    "feature_coverage",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        select="""SELECT count(*) AS records, count(f.track_id) AS with_features
FROM plays_events p LEFT JOIN features f ON p.track_uri = f.track_id""",
    ),
)
def feature_coverage(spark, sf):
    return joins.feature_coverage(
        joins.join_audio_features(plays_from_events(spark, sf), audio_features(spark, sf))
    )


@check(
    "features_matched",
    """SELECT count(*) AS features, count(*) AS matched FROM embeddings""",
)
def features_matched(spark, sf):
    """Every row of the feature table meets a play."""
    features = audio_features(spark, sf)
    joined = joins.join_audio_features(plays_from_events(spark, sf), features)
    matched = joined.agg(F.countDistinct("track_id")).scalar()
    return features.agg(F.count("*").alias("features")).withColumn("matched", matched)


@check(
    "default_features",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        select="""SELECT p.play_id, f.energy, f.tempo, 0.5::DOUBLE AS valence,
  0.5::DOUBLE AS danceability, 0.5::DOUBLE AS instrumentalness, 0.5::DOUBLE AS speechiness,
  0.5::DOUBLE AS acousticness, 0.5::DOUBLE AS liveness
FROM plays_events p LEFT JOIN features f ON p.track_uri = f.track_id""",
    ),
)
def default_features(spark, sf):
    """Only two feature columns exist: the others become constants, their nulls stay."""
    two = audio_features(spark, sf).select("track_id", "energy", "tempo")
    plays = joins.join_audio_features(plays_from_events(spark, sf), two)
    return add_default_features(plays).select(
        "play_id", *[c for c in FEATURES if c != "duration_ms"]
    )


@check(
    "clean_constants",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        select="""SELECT p.play_id, coalesce(track_name, 'Unknown Track') AS track_name,
  coalesce(artist_name, 'Unknown Artist') AS artist_name,
  coalesce(album_name, 'Unknown Album') AS album_name,
  coalesce(shuffle, false) AS shuffle, coalesce(skipped, false) AS skipped,
  coalesce(offline, false) AS offline, coalesce(incognito_mode, false) AS incognito_mode,
  coalesce(platform, 'Unknown') AS platform, coalesce(country, 'Unknown') AS country,
  coalesce(f.key, -1) AS key, coalesce(f.mode, -1) AS mode
FROM (SELECT * REPLACE (CASE WHEN play_id % 11 <> 0 THEN artist_name END AS artist_name,
                        CASE WHEN play_id % 9 <> 0 THEN album_name END AS album_name,
                        CASE WHEN play_id % 10 <> 0 THEN track_name END AS track_name)
      FROM plays_events) p LEFT JOIN features f ON p.track_uri = f.track_id""",
    ),
)
def clean_constants(spark, sf):
    plays = plays_from_events(spark, sf)
    gaps = {"artist_name": 11, "album_name": 9, "track_name": 10}
    plays = plays.withColumns(
        {c: F.when(F.col("play_id") % n != 0, F.col(c)) for c, n in gaps.items()}
    )
    joined = joins.join_audio_features(plays, audio_features(spark, sf))
    names = ["track_name", "artist_name", "album_name"]
    flags = ["shuffle", "skipped", "offline", "incognito_mode"]
    return cleaning.fill_constants(joined).select(
        "play_id", *names, *flags, "platform", "country", "key", "mode"
    )


@check(
    "feature_medians",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        "j AS (SELECT f.* FROM plays_events p LEFT JOIN features f ON p.track_uri = f.track_id)",
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, median({c}) AS median FROM j" for c in FEATURES
        ),
    ),
)
def feature_medians(spark, sf):
    joined = joins.join_audio_features(plays_from_events(spark, sf), audio_features(spark, sf))
    return medians.column_medians(joined, FEATURES)


@check(
    "clean_medians",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        """j AS (SELECT p.play_id, f.* FROM plays_events p
              LEFT JOIN features f ON p.track_uri = f.track_id)""",
        select="SELECT play_id, "
        + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM j)) AS {c}" for c in FEATURES)
        + " FROM j",
    ),
)
def clean_medians(spark, sf):
    joined = joins.join_audio_features(plays_from_events(spark, sf), audio_features(spark, sf))
    stored = materialize(joined.select("play_id", *FEATURES), "joined_features")
    return cleaning.fill_medians(stored)


@check(
    "clean_other_columns",
    with_sql(
        EVENTS_SQL,
        """gaps AS (SELECT play_id,
  CASE WHEN play_id % 3 <> 0 THEN 'agent ' || (play_id % 5) END AS user_agent,
  CASE WHEN play_id % 7 <> 0 THEN '10.0.0.' || (play_id % 9) END AS ip_address,
  CASE WHEN play_id % 4 <> 0 THEN CAST(3 + play_id % 3 AS INTEGER) END AS time_signature,
  CASE WHEN play_id % 5 <> 0 THEN -(play_id % 37) / 2.0::DOUBLE END AS loudness FROM plays_events)""",
        select="""SELECT play_id, coalesce(user_agent, 'Unknown') AS user_agent,
  coalesce(ip_address, 'Unknown') AS ip_address, coalesce(time_signature, -1) AS time_signature,
  coalesce(loudness, (SELECT median(loudness) FROM gaps)) AS loudness FROM gaps""",
    ),
)
def clean_other_columns(spark, sf):
    """The columns that the test tables' plays and features lack."""
    plays = plays_from_events(spark, sf).selectExpr(
        "play_id",
        "IF(play_id % 3 != 0, concat('agent ', play_id % 5), NULL) AS user_agent",
        "IF(play_id % 7 != 0, concat('10.0.0.', play_id % 9), NULL) AS ip_address",
        "IF(play_id % 4 != 0, CAST(3 + play_id % 3 AS INT), NULL) AS time_signature",
        "IF(play_id % 5 != 0, -(play_id % 37) / 2D, NULL) AS loudness",
    )
    return cleaning.fill_missing(plays)


# --- derived columns --------------------------------------------------------------


@check(
    "temporal_features",
    with_sql(ORDERS_SQL, select=f"SELECT play_id, {base.TEMPORAL_SQL} FROM plays_orders"),
)
def temporal_features(spark, sf):
    return add_temporal_features(plays_from_orders(spark, sf)).select("play_id", *TEMPORAL)


@check(
    "temporal_features_events",
    with_sql(EVENTS_SQL, select=f"SELECT play_id, {base.TEMPORAL_SQL} FROM plays_events"),
)
def temporal_features_events(spark, sf):
    return add_temporal_features(plays_from_events(spark, sf)).select("play_id", *TEMPORAL)


@check(
    "behavior_features",
    with_sql(*rows_sql("events"), select=f"SELECT play_id, {commas(*BEHAVIOR)} FROM events_rows"),
)
def behavior_features(spark, sf):
    return rows(spark, sf, "events").select("play_id", *BEHAVIOR)


@check(
    "behavior_features_fallback",
    with_sql(
        ORDERS_SQL,
        filled_sql("orders"),
        select=f"SELECT play_id, {base.BEHAVIOR_FALLBACK_SQL} FROM filled_orders",
    ),
)
def behavior_features_fallback(spark, sf):
    """No duration column: the constant-based rules."""
    return add_behavior_features(plays_from_orders(spark, sf)).select("play_id", *BEHAVIOR)


@check(
    "audio_features",
    with_sql(
        *rows_sql("events"),
        select=f"""SELECT * REPLACE (round(musical_complexity, 9) AS musical_complexity)
FROM (SELECT play_id, {commas(*AUDIO)} FROM events_rows)""",
    ),
)
def audio_feature_columns(spark, sf):
    joined = joins.join_audio_features(plays_from_events(spark, sf), audio_features(spark, sf))
    derived = add_audio_features(joined).select("play_id", *AUDIO)
    return rounded(derived, 9, "musical_complexity")


@check(
    "content_flags",
    with_sql(EVENTS_SQL, select=f"SELECT play_id, {base.FLAGS_SQL} FROM plays_events"),
)
def content_flags(spark, sf):
    return add_content_flags(plays_from_events(spark, sf)).select("play_id", *FLAGS)


# --- sessions ---------------------------------------------------------------------


@check(
    "session_gaps",
    with_sql(
        *rows_sql("events"),
        sessions_sql("events"),
        select="SELECT play_id, time_since_last, new_session FROM events_sessions",
    ),
)
def session_gaps(spark, sf):
    return sessions.attach_gaps(plays_from_events(spark, sf)).select(
        "play_id", "time_since_last", "new_session"
    )


@check(
    "session_gaps_fanout",
    with_sql(
        EVENTS_SQL,
        FEATURES_SQL,
        """doubled AS (SELECT track_id, tempo FROM features
              UNION ALL SELECT track_id, tempo + 1 FROM features WHERE key % 2 = 0)""",
        "filled AS (SELECT p.*, f.tempo FROM plays_events p LEFT JOIN doubled f ON p.track_uri = f.track_id)",
        """gaps AS (SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w AS gap_us
              FROM filled WINDOW w AS (PARTITION BY content_type ORDER BY timestamp, play_id))""",
        select="""SELECT play_id, gap_us / 1000.0 AS time_since_last,
  gap_us IS NULL OR gap_us > 1800000000 AS new_session,
  CAST(sum(CASE WHEN gap_us IS NULL OR gap_us > 1800000000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY content_type ORDER BY timestamp, play_id) AS BIGINT) AS session_id
FROM gaps""",
    ),
)
def session_gaps_fanout(spark, sf):
    """Repeated track ids double plays; of the twins one keeps the gap, the other follows it."""
    features = audio_features(spark, sf).select("track_id", "tempo", "key")
    again = features.filter("key % 2 = 0").withColumn("tempo", F.col("tempo") + 1)
    plays = enrich(plays_from_events(spark, sf), features.union(again).drop("key"))
    return plays.select("play_id", "time_since_last", "new_session", "session_id")


@check(
    "session_gaps_null_user",
    with_sql(
        EVENTS_SQL,
        """gaps AS (SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w AS gap_us
              FROM (SELECT * REPLACE (CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id)
                    FROM plays_events)
              WINDOW w AS (PARTITION BY user_id, content_type ORDER BY timestamp, play_id))""",
        select="""SELECT play_id, gap_us / 1000.0 AS time_since_last,
  gap_us IS NULL OR gap_us > 86400000000 AS new_session,
  CAST(sum(CASE WHEN gap_us IS NULL OR gap_us > 86400000000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id, content_type ORDER BY timestamp, play_id) AS BIGINT) AS session_id
FROM gaps""",
    ),
)
def session_gaps_null_user(spark, sf):
    """Plays without user form timelines of their own, in gaps and sessions alike."""
    params = PlayParams(keys=("user_id", "content_type"), session_timeout_ms=86_400_000)
    plays = plays_from_events(spark, sf).withColumn(
        "user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    )
    both = sessions.add_session_features(plays, params)
    return both.select("play_id", "time_since_last", "new_session", "session_id")


SESSION_SELECT = """SELECT play_id, session_id,
  CAST(sum(ms_played) OVER s AS BIGINT) AS session_duration,
  count(track_name) OVER s AS tracks_in_session,
  min(timestamp) OVER s AS session_start, max(timestamp) OVER s AS session_end,
  CAST(sum(ms_played) OVER s AS DOUBLE) / 60000 AS session_duration_minutes"""


@check(
    "session_plays",
    with_sql(
        *rows_sql("events"),
        sessions_sql("events"),
        select=f"""{SESSION_SELECT}
FROM events_sessions WINDOW s AS (PARTITION BY content_type, session_id)""",
    ),
)
def session_plays(spark, sf):
    return sessions.attach_sessions(plays_from_events(spark, sf)).select("play_id", *SESSION)


@check(
    "session_plays_by_user",
    with_sql(
        *rows_sql("events"),
        sessions_sql("events", 86_400_000_000, "user_id, content_type"),
        select=f"""{SESSION_SELECT}
FROM events_sessions WINDOW s AS (PARTITION BY user_id, content_type, session_id)""",
    ),
)
def session_plays_by_user(spark, sf):
    """Many short timelines instead of four long ones, with a one-day timeout."""
    params = PlayParams(keys=("user_id", "content_type"), session_timeout_ms=86_400_000)
    placed = sessions.attach_sessions(plays_from_events(spark, sf), params)
    return placed.select("play_id", *SESSION)


@check(
    "derived_metrics",
    with_sql(
        *rows_sql("events")[:3],
        "medians AS (SELECT "
        + ", ".join(f"median({c}) AS m_{c}" for c in FEATURES)
        + " FROM filled_events p LEFT JOIN features f ON p.track_uri = f.track_id)",
        "joined_events AS (SELECT p.*, "
        + ", ".join(f"coalesce(f.{c}, m.m_{c}) AS {c}" for c in FEATURES)
        + """ FROM filled_events p LEFT JOIN features f ON p.track_uri = f.track_id
             CROSS JOIN medians m)""",
        rows_sql("events")[4],
        sessions_sql("events"),
        select=f"""SELECT * REPLACE (round(musical_complexity, 9) AS musical_complexity,
  round(listening_efficiency, 9) AS listening_efficiency) FROM (
{SESSION_SELECT}, {commas(*TEMPORAL, *BEHAVIOR, *AUDIO, *FLAGS)}, time_since_last, new_session
FROM events_sessions WINDOW s AS (PARTITION BY content_type, session_id))""",
    ),
)
def derived_metrics(spark, sf):
    """The whole enrichment: join, clean, derive."""
    enriched = enrich(
        plays_from_events(spark, sf), audio_features(spark, sf), unique_features=True
    ).select(
        "play_id",
        *SESSION,
        *TEMPORAL,
        *BEHAVIOR,
        *AUDIO,
        *FLAGS,
        "time_since_last",
        "new_session",
    )
    return rounded(enriched, 9, "musical_complexity", "listening_efficiency")
