"""The driver's tables seen as plays and audio features, in Spark and in SQL.

The two renderings are written independently; the SQL one runs on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _track_uri(spark: SparkSession, sf_dir: str) -> Column:
    """A track of the feature table for most plays, whatever its size; of eleven plays one
    has no uri and one has an unknown track."""
    tracks = read(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).scalar()
    known = F.concat(F.lit("track:"), F.pmod(F.col("play_id"), tracks).cast("string"))
    unknown = F.when(F.col("play_id") % 11 == 7, F.lit("track:none")).otherwise(known)
    return F.when(F.col("play_id") % 11 != 3, unknown)


_TRACK_URI_SQL = """CASE {id} % 11 WHEN 3 THEN NULL WHEN 7 THEN 'track:none'
           ELSE 'track:' || ({id} % (SELECT max(vec_id) + 1 FROM embeddings)) END AS track_uri"""


def plays_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read(spark, sf_dir, "events").selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"
    )
    plays = keyed.selectExpr(
        "event_id AS play_id",
        "user_id",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "concat('track_', k) AS track_name",
        "concat('artist_', k % 20) AS artist_name",
        "concat('album_', k % 40) AS album_name",
        "CAST(NULL AS STRING) AS track_uri",
        "CAST(round(value * 4000) AS BIGINT) AS ms_played",
        "CAST(NULL AS BOOLEAN) AS shuffle",
        "IF(event_id % 13 != 0, event_id % 7 = 0, NULL) AS skipped",
        "IF(event_id % 5 != 0, event_id % 2 = 0, NULL) AS offline",
        "CAST(NULL AS BOOLEAN) AS incognito_mode",
        """element_at(array('android', 'ios', 'web_player', 'desktop', 'Cast to device', NULL),
                      CAST(user_id % 6 AS INT) + 1) AS platform""",
        "IF(event_id % 4 != 0, 'DE', NULL) AS country",
        """coalesce(element_at(map('view', 'podcast', 'purchase', 'audiobook', 'signup', 'video'),
                               event_type), 'music') AS content_type""",
    )
    return plays.withColumn("track_uri", _track_uri(spark, sf_dir))


EVENTS_SQL = f"""
plays_events AS (
  SELECT event_id AS play_id, user_id, ts AS timestamp,
         'track_' || json_extract_string(props, '$.k') AS track_name,
         'artist_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS artist_name,
         'album_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 40) AS album_name,
         {_TRACK_URI_SQL.format(id='event_id')},
         CAST(round(value * 4000) AS BIGINT) AS ms_played,
         CAST(NULL AS BOOLEAN) AS shuffle,
         CASE WHEN event_id % 13 <> 0 THEN event_id % 7 = 0 END AS skipped,
         CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 0 END AS offline,
         CAST(NULL AS BOOLEAN) AS incognito_mode,
         CASE user_id % 6 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'web_player'
              WHEN 3 THEN 'desktop' WHEN 4 THEN 'Cast to device' END AS platform,
         CASE WHEN event_id % 4 <> 0 THEN 'DE' END AS country,
         CASE event_type WHEN 'view' THEN 'podcast' WHEN 'purchase' THEN 'audiobook'
              WHEN 'signup' THEN 'video' ELSE 'music' END AS content_type
  FROM events)"""


def plays_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS play_id",
        """timestamp_micros(unix_micros(CAST(o_orderdate AS TIMESTAMP))
                            + o_orderkey % 1440 * 60000000) AS timestamp""",
        "concat('order_', o_orderkey) AS track_name",
        "concat('artist_', o_custkey) AS artist_name",
        "concat('album_', o_custkey % 97) AS album_name",
        "CAST(NULL AS STRING) AS track_uri",
        "CAST(round(o_totalprice) AS BIGINT) AS ms_played",
        "o_orderkey % 7 = 0 AS skipped",
        """try_element_at(map('1', 'iOS', '2', 'web_player', '3', 'Desktop', '4', 'Android OS 9'),
                          substr(o_orderpriority, 1, 1)) AS platform""",
        """CASE o_orderstatus WHEN 'F' THEN 'music' WHEN 'O' THEN 'podcast'
              ELSE 'audiobook' END AS content_type""",
    )
    return plays.withColumn("track_uri", _track_uri(spark, sf_dir))


ORDERS_SQL = f"""
plays_orders AS (
  SELECT o_orderkey AS play_id,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS timestamp,
         'order_' || o_orderkey AS track_name,
         'artist_' || o_custkey AS artist_name,
         'album_' || (o_custkey % 97) AS album_name,
         {_TRACK_URI_SQL.format(id='o_orderkey')},
         CAST(round(o_totalprice) AS BIGINT) AS ms_played,
         o_orderkey % 7 = 0 AS skipped,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'iOS' WHEN '2' THEN 'web_player'
              WHEN '3' THEN 'Desktop' WHEN '4' THEN 'Android OS 9' END AS platform,
         CASE o_orderstatus WHEN 'F' THEN 'music' WHEN 'O' THEN 'podcast'
              ELSE 'audiobook' END AS content_type
  FROM orders)"""


# Position in the embedding -> feature, for the features that map to [0, 1].
FEATURE_SLOTS = (
    "danceability",
    "energy",
    "valence",
    "acousticness",
    "instrumentalness",
    "speechiness",
    "liveness",
)


def audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def unit(i: int) -> str:
        return f"least(1D, greatest(0D, 0.5D + 3D * CAST(embedding[{i}] AS DOUBLE)))"

    return (
        read(spark, sf_dir, "embeddings")
        .selectExpr(
            "concat('track:', vec_id) AS track_id",
            *[f"{unit(i)} AS {name}" for i, name in enumerate(FEATURE_SLOTS)],
            f"40D + 240D * {unit(7)} AS tempo",
            "60000D + 1000D * (vec_id % 300) AS duration_ms",
            "CAST(vec_id % 12 AS INT) AS key",
            "IF(vec_id % 3 != 0, CAST(vec_id % 2 AS INT), NULL) AS mode",
        )
    )


def _unit_sql(i: int) -> str:
    return f"least(1.0, greatest(0.0, CAST(0.5 AS DOUBLE) + 3.0 * CAST(embedding[{i + 1}] AS DOUBLE)))"


FEATURES_SQL = f"""
features AS (
  SELECT 'track:' || vec_id AS track_id,
         {", ".join(f"{_unit_sql(i)} AS {n}" for i, n in enumerate(FEATURE_SLOTS))},
         40.0 + 240.0 * {_unit_sql(7)} AS tempo,
         CAST(60000 + 1000 * (vec_id % 300) AS DOUBLE) AS duration_ms,
         CAST(vec_id % 12 AS INTEGER) AS key,
         CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 2 AS INTEGER) END AS mode
  FROM embeddings)"""
