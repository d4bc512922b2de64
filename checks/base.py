"""Enriched rows the checks start from, in Spark and in SQL.

``event_rows``/``order_rows``: constants filled, features joined, row features derived;
nulls in the features stay (medians have checks of their own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.adapters import (
    EVENTS_SQL,
    FEATURES_SQL,
    ORDERS_SQL,
    audio_features,
    plays_from_events,
    plays_from_orders,
)
from playtrail.operators.cleaning import fill_constants
from playtrail.operators.joins import join_audio_features
from playtrail.operators.sessions import attach_sessions
from playtrail.plans.enrich import add_row_features

PLAYS = {"events": plays_from_events, "orders": plays_from_orders}


def rows(spark: SparkSession, sf_dir: str, source: str, sessions: bool = False) -> DataFrame:
    plays = fill_constants(PLAYS[source](spark, sf_dir))
    if sessions:
        plays = attach_sessions(plays)
    return add_row_features(join_audio_features(plays, audio_features(spark, sf_dir)))


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def filled_sql(source: str) -> str:
    """CTE ``filled_<source>``: constants filled."""
    extra = {
        "events": """coalesce(shuffle, false) AS shuffle, coalesce(offline, false) AS offline,
         coalesce(incognito_mode, false) AS incognito_mode,
         coalesce(country, 'Unknown') AS country, user_id,""",
        "orders": "",
    }[source]
    return f"""
filled_{source} AS (
  SELECT play_id, timestamp, coalesce(track_name, 'Unknown Track') AS track_name,
         coalesce(artist_name, 'Unknown Artist') AS artist_name,
         coalesce(album_name, 'Unknown Album') AS album_name,
         track_uri, ms_played, coalesce(skipped, false) AS skipped, {extra}
         coalesce(platform, 'Unknown') AS platform, content_type
  FROM plays_{source})"""


TEMPORAL_SQL = """
         CAST(timestamp AS DATE) AS date,
         CAST(extract(year FROM timestamp) AS INTEGER) AS year,
         CAST(extract(month FROM timestamp) AS INTEGER) AS month,
         CAST(extract(day FROM timestamp) AS INTEGER) AS day,
         CAST(extract(hour FROM timestamp) AS INTEGER) AS hour,
         CAST(extract(isodow FROM timestamp) - 1 AS INTEGER) AS day_of_week,
         CAST(extract(doy FROM timestamp) AS INTEGER) AS day_of_year,
         CAST(extract(week FROM timestamp) AS INTEGER) AS week_of_year,
         CAST(extract(quarter FROM timestamp) AS INTEGER) AS quarter,
         CASE WHEN extract(hour FROM timestamp) <= 6 THEN 'Night'
              WHEN extract(hour FROM timestamp) <= 12 THEN 'Morning'
              WHEN extract(hour FROM timestamp) <= 18 THEN 'Afternoon'
              ELSE 'Evening' END AS time_of_day,
         CASE WHEN extract(isodow FROM timestamp) >= 6 THEN 'Weekend'
              ELSE dayname(timestamp) END AS day_type,
         CASE WHEN extract(month FROM timestamp) <= 3 THEN 'Winter'
              WHEN extract(month FROM timestamp) <= 6 THEN 'Spring'
              WHEN extract(month FROM timestamp) <= 9 THEN 'Summer'
              ELSE 'Fall' END AS season"""

PLATFORM_SQL = """
         CASE lower(platform) WHEN 'android' THEN 'Mobile' WHEN 'ios' THEN 'Mobile'
              WHEN 'web_player' THEN 'Web' WHEN 'desktop' THEN 'Desktop'
              WHEN 'unknown' THEN 'Unknown' ELSE 'Other' END AS platform_category"""

# With a track duration (null where the features did not match).
BEHAVIOR_SQL = f"""
         CAST(ms_played AS DOUBLE) / 60000 AS listening_duration_minutes,
         skipped AS is_skip,
         coalesce(ms_played / nullif(duration_ms, 0) < 0.3, false) AS skip_by_duration,
         coalesce(ms_played >= 30000, false)
           AND NOT coalesce(ms_played / nullif(duration_ms, 0) < 0.3, false) AS is_complete_listen,
         CASE WHEN duration_ms > 0 THEN ms_played / duration_ms ELSE 0.0 END AS listening_efficiency,
         {PLATFORM_SQL}"""

# Without a duration column.
BEHAVIOR_FALLBACK_SQL = f"""
         CAST(ms_played AS DOUBLE) / 60000 AS listening_duration_minutes,
         skipped AS is_skip,
         coalesce(ms_played < 30000, false) AS skip_by_duration,
         coalesce(ms_played >= 30000, false) AS is_complete_listen,
         CASE WHEN ms_played > 0 THEN least(CAST(ms_played AS DOUBLE) / 180000, 1.0)
              ELSE 0.0 END AS listening_efficiency,
         {PLATFORM_SQL}"""


def _level(column: str) -> str:
    return (
        f"CASE WHEN {column} < 0 THEN NULL WHEN {column} <= 0.33 THEN 'Low' "
        f"WHEN {column} <= 0.66 THEN 'Medium' WHEN {column} <= 1 THEN 'High' END"
    )


AUDIO_SQL = f"""
         CASE WHEN valence >= 0.5 AND energy >= 0.5 THEN 'Happy'
              WHEN valence >= 0.5 AND energy < 0.5 THEN 'Calm'
              WHEN valence < 0.5 AND energy >= 0.5 THEN 'Energetic'
              WHEN valence < 0.5 AND energy < 0.5 THEN 'Sad' ELSE 'Neutral' END AS mood,
         {_level("energy")} AS energy_level,
         {_level("danceability")} AS danceability_level,
         CASE WHEN (SELECT count(tempo) FROM features) = 0 THEN 'Unknown'
              WHEN tempo < 0 THEN NULL WHEN tempo <= 60 THEN 'Larghissimo'
              WHEN tempo <= 90 THEN 'Largo' WHEN tempo <= 120 THEN 'Moderato'
              WHEN tempo <= 150 THEN 'Allegro' WHEN tempo <= 200 THEN 'Vivace'
              WHEN tempo <= 300 THEN 'Presto' END AS tempo_category,
         instrumentalness * 0.3 + speechiness * 0.2 + (1 - acousticness) * 0.3 + liveness * 0.2
           AS musical_complexity,
         CASE WHEN danceability > 0.7 AND energy > 0.7 THEN 'Pop/Dance'
              WHEN acousticness > 0.7 AND instrumentalness < 0.3 THEN 'Folk/Acoustic'
              WHEN instrumentalness > 0.7 THEN 'Instrumental'
              WHEN speechiness > 0.5 THEN 'Hip-Hop/Rap'
              WHEN energy > 0.8 AND tempo > 140 THEN 'Electronic'
              WHEN valence < 0.3 AND energy < 0.5 THEN 'Sad/Emo'
              ELSE 'Other' END AS inferred_genre"""

FLAGS_SQL = """
         content_type = 'music' AS is_music, content_type = 'podcast' AS is_podcast,
         content_type = 'audiobook' AS is_audiobook, content_type = 'video' AS is_video,
         CAST(ms_played AS DOUBLE) / 3600000 AS content_duration_hours"""


def rows_sql(source: str) -> tuple[str, ...]:
    """CTEs up to ``<source>_rows``."""
    plays = {"events": EVENTS_SQL, "orders": ORDERS_SQL}[source]
    joined = f"""
joined_{source} AS (
  SELECT p.*, f.* FROM filled_{source} p LEFT JOIN features f ON p.track_uri = f.track_id)"""
    derived = f"""
{source}_rows AS (
  SELECT *, {TEMPORAL_SQL}, {BEHAVIOR_SQL}, {AUDIO_SQL}, {FLAGS_SQL}
  FROM joined_{source})"""
    return (plays, FEATURES_SQL, filled_sql(source), joined, derived)


def sessions_sql(
    source: str, timeout_us: int = 1_800_000_000, keys: str = "content_type"
) -> str:
    """CTE ``<source>_sessions``: the rows with gap and session id, by sorting plays."""
    return f"""
{source}_gaps AS (
  SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w AS gap_us
  FROM {source}_rows WINDOW w AS (PARTITION BY {keys} ORDER BY timestamp, play_id)),
{source}_sessions AS (
  SELECT *, gap_us / 1000.0 AS time_since_last,
         gap_us IS NULL OR gap_us > {timeout_us} AS new_session,
         CAST(sum(CASE WHEN gap_us IS NULL OR gap_us > {timeout_us} THEN 1 ELSE 0 END) OVER (
           PARTITION BY {keys} ORDER BY timestamp, play_id) AS BIGINT) AS session_id
  FROM {source}_gaps)"""
