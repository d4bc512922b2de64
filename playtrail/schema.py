"""The canonical plays schema and the closed value domains used by the rollups."""

from __future__ import annotations

from pyspark.sql import types as T

PLAYS_SCHEMA = T.StructType(
    [
        T.StructField("play_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("track_uri", T.StringType()),
        T.StructField("ms_played", T.LongType()),
        T.StructField("reason_start", T.StringType()),
        T.StructField("reason_end", T.StringType()),
        T.StructField("shuffle", T.BooleanType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("offline", T.BooleanType()),
        T.StructField("offline_timestamp", T.TimestampType()),
        T.StructField("incognito_mode", T.BooleanType()),
        T.StructField("platform", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("file_source", T.StringType()),
    ]
)

# As written by the parser: plays plus how the timestamp was read.
PARSED_SCHEMA = T.StructType([*PLAYS_SCHEMA, T.StructField("ts_status", T.StringType())])

# Ordered category levels.
TIME_OF_DAY = ("Night", "Morning", "Afternoon", "Evening")
SEASONS = ("Winter", "Spring", "Summer", "Fall")
INTENSITY = ("Low", "Medium", "High")
TEMPO_NAMES = ("Larghissimo", "Largo", "Moderato", "Allegro", "Vivace", "Presto")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
CONTENT_TYPES = ("music", "podcast", "audiobook", "video")

# Right-closed bin edges, first bin closed on both sides.
HOUR_EDGES = (0, 6, 12, 18, 24)
MONTH_EDGES = (0, 3, 6, 9, 12)
INTENSITY_EDGES = (0.0, 0.33, 0.66, 1.0)
TEMPO_EDGES = (0.0, 60.0, 90.0, 120.0, 150.0, 200.0, 300.0)

# Audio feature columns.
AUDIO_CODES = ("key", "mode", "time_signature")
AUDIO_MEASURES = (
    "danceability",
    "energy",
    "loudness",
    "speechiness",
    "acousticness",
    "instrumentalness",
    "liveness",
    "valence",
    "tempo",
    "duration_ms",
)
AUDIO_DEFAULTED = (
    "valence",
    "energy",
    "danceability",
    "tempo",
    "instrumentalness",
    "speechiness",
    "acousticness",
    "liveness",
)
AUDIO_MEANS = ("valence", "energy", "danceability", "tempo")

# Columns whose number of values is fixed by the definitions above, whatever the
# amount of data.  A table with one row per combination of these is safe to
# broadcast.
CLOSED_DOMAINS = frozenset(
    {"content_type", "time_of_day", "season", "mood", "platform_category", "feature"}
)

MS_PER_MINUTE = 60_000
MS_PER_HOUR = 3_600_000
