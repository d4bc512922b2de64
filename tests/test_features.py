"""Boundary values of the row-level columns."""

from datetime import datetime

from pyspark.sql import functions as F

from playtrail.functions.audio import add_audio_features, add_default_features
from playtrail.functions.behavior import add_behavior_features
from playtrail.functions.temporal import add_temporal_features


def column(df, name):
    return [row[name] for row in df.select(name).collect()]


def at(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.to_timestamp("t").alias("timestamp")
    )


def test_time_of_day_edges(spark):
    hours = [0, 6, 7, 12, 13, 18, 19, 23]
    df = add_temporal_features(at(spark, *[f"2024-05-01 {h:02d}:59:59" for h in hours]))
    want = ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening"]
    assert column(df, "time_of_day") == want
    assert column(df, "time_of_day_ord") == [0, 0, 1, 1, 2, 2, 3, 3]


def test_season_edges(spark):
    months = [1, 3, 4, 6, 7, 9, 10, 12]
    df = add_temporal_features(at(spark, *[f"2023-{m:02d}-15 00:00:00" for m in months]))
    assert column(df, "season") == [
        "Winter", "Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall",
    ]


def test_calendar_year_with_iso_week(spark):
    row = add_temporal_features(at(spark, "2024-12-30 10:00:00")).first()
    assert (row.year, row.week_of_year, row.day_of_week, row.day_type) == (2024, 1, 0, "Monday")


def test_weekend(spark):
    df = add_temporal_features(at(spark, "2024-01-05 00:00:00", "2024-01-06 00:00:00", "2024-01-07 00:00:00"))
    assert column(df, "day_type") == ["Friday", "Weekend", "Weekend"]
    assert column(df, "day_of_week") == [4, 5, 6]


def behaviour(spark, rows, schema):
    return add_behavior_features(spark.createDataFrame(rows, schema))


def test_skip_and_completion_without_duration(spark):
    rows = [(None, None, None), (0, False, "x"), (29_999, True, "x"), (30_000, None, "x"), (360_000, False, "x")]
    df = behaviour(spark, rows, "ms_played bigint, skipped boolean, platform string")
    assert column(df, "is_skip") == [False, False, True, False, False]
    assert column(df, "skip_by_duration") == [False, True, True, False, False]
    assert column(df, "is_complete_listen") == [False, False, False, True, True]
    assert column(df, "listening_efficiency") == [0.0, 0.0, 29_999 / 180_000, 1 / 6, 1.0]


def test_skip_and_completion_with_duration(spark):
    rows = [(30_000, None), (30_000, 0.0), (30_000, 100_000.0), (29_999, 100_000.0), (60_000, 30_000.0)]
    df = behaviour(
        spark.createDataFrame(rows, "ms_played bigint, duration_ms double")
        .withColumns({"skipped": F.lit(False), "platform": F.lit("x")})
        .sparkSession,
        [(a, b, False, "x") for a, b in rows],
        "ms_played bigint, duration_ms double, skipped boolean, platform string",
    )
    assert column(df, "skip_by_duration") == [False, False, False, True, False]
    assert column(df, "is_complete_listen") == [True, True, True, False, True]
    assert column(df, "listening_efficiency") == [0.0, 0.0, 0.3, 0.29999, 2.0]


def test_platform_category(spark):
    names = ["ANDROID", "iOS", "web_player", "Desktop", "Android OS 9", "Unknown", None]
    df = behaviour(spark, [(1, False, n) for n in names], "ms_played bigint, skipped boolean, platform string")
    assert column(df, "platform_category") == [
        "Mobile", "Mobile", "Web", "Desktop", "Other", "Unknown", "Unknown",
    ]


FEATURES = (
    "valence double, energy double, danceability double, tempo double, instrumentalness double,"
    " speechiness double, acousticness double, liveness double"
)


def test_levels_and_mood_edges(spark):
    values = [None, 0.0, 0.33, 0.5, 0.66, 0.7, 1.0, 1.01, -0.1]
    rows = [(v, v, v, 100.0, 0.0, 0.0, 0.0, 0.0) for v in values]
    df = add_audio_features(spark.createDataFrame(rows, FEATURES))
    levels = [None, "Low", "Low", "Medium", "Medium", "High", "High", None, None]
    assert column(df, "energy_level") == levels
    assert column(df, "danceability_level") == levels
    assert column(df, "mood") == ["Neutral", "Sad", "Sad", "Happy", "Happy", "Happy", "Happy", "Happy", "Sad"]


def test_tempo_edges(spark):
    tempos = [0.0, 60.0, 60.5, 90.0, 120.0, 150.0, 200.0, 300.0, 301.0, None]
    df = add_audio_features(spark.createDataFrame([(0.0, 0.0, 0.0, t, 0.0, 0.0, 0.0, 0.0) for t in tempos], FEATURES))
    assert column(df, "tempo_category") == [
        "Larghissimo", "Larghissimo", "Largo", "Largo", "Moderato", "Allegro", "Vivace", "Presto", None, None,
    ]


def test_tempo_unknown_only_if_no_row_has_one(spark):
    df = add_audio_features(spark.createDataFrame([(0.0, 0.0, 0.0, None, 0.0, 0.0, 0.0, 0.0)] * 2, FEATURES))
    assert column(df, "tempo_category") == ["Unknown", "Unknown"]


def test_genre_first_match_wins(spark):
    rows = [  # valence, energy, dance, tempo, instrumental, speech, acoustic, live
        (0.5, 0.8, 0.8, 0.0, 0.9, 0.9, 0.9, 0.0),
        (0.5, 0.5, 0.5, 0.0, 0.2, 0.9, 0.8, 0.0),
        (0.5, 0.5, 0.5, 0.0, 0.8, 0.9, 0.8, 0.0),
        (0.5, 0.5, 0.5, 0.0, 0.5, 0.6, 0.5, 0.0),
        (0.5, 0.9, 0.5, 141.0, 0.5, 0.5, 0.5, 0.0),
        (0.2, 0.4, 0.5, 0.0, 0.5, 0.5, 0.5, 0.0),
        (0.7, 0.7, 0.7, 140.0, 0.7, 0.5, 0.7, 0.0),
        (None, None, None, None, None, None, None, None),
    ]
    df = add_audio_features(spark.createDataFrame(rows, FEATURES))
    assert column(df, "inferred_genre") == [
        "Pop/Dance", "Folk/Acoustic", "Instrumental", "Hip-Hop/Rap", "Electronic", "Sad/Emo", "Other", "Other",
    ]


def test_no_feature_columns_give_the_neutral_row(spark):
    row = add_audio_features(spark.range(1)).first()
    assert (row.mood, row.inferred_genre, row.tempo_category) == ("Happy", "Other", "Larghissimo")
    assert abs(row.musical_complexity - 0.5) < 1e-12
    assert add_default_features(spark.range(1)).first().liveness == 0.5


def test_days_are_dates(spark, sf):
    """The checks show days as midnight timestamps, so their type is asserted here."""
    from checks.base import rows
    from playtrail.plans import explore, rollups, temporal

    plays = rows(spark, sf, "events")
    for table in (plays, rollups.daily_stats(plays), temporal.daily_pattern_stats(plays), explore.daily_hours(plays)):
        assert dict(table.dtypes)["date"] == "date"
    options = dict(explore.filter_options(plays).dtypes)
    assert options["min_date"] == options["max_date"] == "date"
