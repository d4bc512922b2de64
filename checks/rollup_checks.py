"""Rollups, summary, temporal patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import rows, rows_sql, sessions_sql, with_sql
from checks.registry import big, check, hours, r, rate, rounded
from playtrail.operators.rollup import name_cube, play_cube
from playtrail.plans import rollups as A
from playtrail.plans import session_behavior as Q
from playtrail.plans import temporal as P
from playtrail.schema import AUDIO_MEANS
from playtrail.session import materialize

MEANS = ("valence", "energy", "danceability", "tempo")
E, O = rows_sql("events"), rows_sql("orders")
E_SESSIONS, O_SESSIONS = sessions_sql("events"), sessions_sql("orders")

MS = big("coalesce(sum(ms_played), 0)", "ms_played")
PLAYS = "count(track_name) AS plays"
SKIPS = "count(*) FILTER (is_skip) AS skips"
DONE = "count(*) FILTER (is_complete_listen) AS completes"
RAW_MEANS = ", ".join(f"avg({c}) AS {c}" for c in MEANS)
HOURS = hours("ms_played")
RATES = rate("skips", "plays", "skip_rate") + ", " + rate("completes", "plays", "completion_rate")
ROUND_MEANS = ", ".join(f"round({c}, 6) AS {c}" for c in MEANS)


def means6(df):
    return rounded(df, 6, *[c for c in (*MEANS, "listening_efficiency") if c in df.columns])


def six(select: str, columns=MEANS) -> str:
    inner = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({inner}) FROM ({select})"


def grouped(source: str, keys: str, *measures: str) -> str:
    """An aggregate with hours and the rates its measures allow."""
    extra = []
    if MS in measures:
        extra.append(HOURS)
    if SKIPS in measures:
        extra.append(rate("skips", "plays", "skip_rate"))
    if DONE in measures:
        extra.append(rate("completes", "plays", "completion_rate"))
    more = "".join(f", {x}" for x in extra)
    return f"""SELECT *{more} FROM (
  SELECT {keys}, {", ".join(measures)} FROM {source} GROUP BY {keys})"""


# Dense grids: all levels x observed content types.
def dense(source: str, level: str, levels: tuple[str, ...], zero: dict, other: dict) -> str:
    values = ", ".join(f"('{name}', {i})" for i, name in enumerate(levels))
    picks = [f"coalesce({e}, 0) AS {n}" for n, e in zero.items()]
    picks += [f"{e} AS {n}" for n, e in other.items()]
    return f"""SELECT l.{level}, l.{level}_ord, c.content_type, {", ".join(picks)}
FROM (VALUES {values}) AS l({level}, {level}_ord)
CROSS JOIN (SELECT DISTINCT content_type FROM {source}) c
LEFT JOIN {source} e ON e.{level} = l.{level} AND e.content_type = c.content_type
GROUP BY l.{level}, l.{level}_ord, c.content_type"""


TIMES = ("Night", "Morning", "Afternoon", "Evening")
SEASON_NAMES = ("Winter", "Spring", "Summer", "Fall")
COUNTS = {"ms_played": "CAST(sum(ms_played) AS BIGINT)", "plays": "count(track_name)"}
AVERAGES = {c: f"avg({c})" for c in MEANS}


def times(source: str) -> str:
    return f"SELECT *, {HOURS} FROM ({dense(source, 'time_of_day', TIMES, COUNTS, AVERAGES)})"


def seasons(source: str) -> str:
    zero = {**COUNTS, "unique_artists": "count(DISTINCT artist_name)"}
    return f"SELECT *, {HOURS} FROM ({dense(source, 'season', SEASON_NAMES, zero, AVERAGES)})"


DAILY = grouped(
    "events_rows",
    "date, content_type",
    MS,
    PLAYS,
    DONE,
    SKIPS,
    "avg(listening_efficiency) AS listening_efficiency",
    RAW_MEANS,
)
DAILY6 = six(DAILY, (*MEANS, "listening_efficiency"))


@check("daily_stats", with_sql(*E, select=DAILY6))
def daily_stats(spark, sf):
    return means6(A.daily_stats(rows(spark, sf, "events")))


@check("daily_stats_from_cube", with_sql(*E, select=DAILY6))
def daily_stats_from_cube(spark, sf):
    return means6(A.daily_stats(play_cube(rows(spark, sf, "events"))))


NAMES = (
    "count(DISTINCT artist_name) AS unique_artists",
    "count(DISTINCT album_name) AS unique_albums",
)
SESSIONS = "count(DISTINCT session_id) AS total_sessions"
WEEKLY = grouped(
    "orders_rows", "year, week_of_year, content_type", MS, PLAYS, *NAMES, RAW_MEANS
)
WEEKLY_S = grouped(
    "orders_sessions", "year, week_of_year, content_type", MS, PLAYS, *NAMES, RAW_MEANS, SESSIONS
)
MONTHLY = grouped(
    "orders_sessions", "year, month, content_type", MS, PLAYS, *NAMES, RAW_MEANS, SESSIONS
)


#: What cubes of names and of sessions are made of.
_CUBED = (
    *("date", "content_type", "platform_category", "artist_name", "album_name", "session_id", "track_name"),
    *("ms_played", "is_skip", "is_complete_listen", "listening_efficiency", *AUDIO_MEANS),
)


@check("weekly_stats", with_sql(*O, select=six(WEEKLY)))
def weekly_stats(spark, sf):
    return means6(A.weekly_stats(rows(spark, sf, "orders")))


@check("weekly_stats_from_cube", with_sql(*O, select=six(WEEKLY)))
def weekly_stats_from_cube(spark, sf):
    return means6(A.weekly_stats(name_cube(rows(spark, sf, "orders"))))


@check("monthly_stats", with_sql(*O, O_SESSIONS, select=six(MONTHLY)))
def monthly_stats(spark, sf):
    """The plays with their sessions are stored once, for two cubes."""
    plays = rows(spark, sf, "orders", sessions=True).select(*_CUBED)
    return means6(A.monthly_stats(materialize(plays, "placed_plays")))


@check("monthly_stats_from_cubes", with_sql(*O, O_SESSIONS, select=six(MONTHLY)))
def monthly_stats_from_cubes(spark, sf):
    placed = rows(spark, sf, "orders", sessions=True)
    return means6(A.monthly_stats(name_cube(rows(spark, sf, "orders")), A.session_cube(placed)))


ARTISTS = grouped(
    "events_rows",
    "artist_name",
    MS,
    PLAYS,
    "count(DISTINCT album_name) AS unique_albums",
    RAW_MEANS,
    "avg(listening_efficiency) AS listening_efficiency",
    DONE,
    SKIPS,
)


@check("artist_stats", with_sql(*E, select=six(ARTISTS, (*MEANS, "listening_efficiency"))))
def artist_stats(spark, sf):
    return means6(A.artist_stats(rows(spark, sf, "events")))


@check("time_stats", with_sql(*E, select=six(times("events_rows"))))
def time_stats(spark, sf):
    return means6(A.time_stats(rows(spark, sf, "events")))


MIDNIGHT = """night AS (SELECT * REPLACE ('Night' AS time_of_day) FROM orders_rows)"""


@check("time_stats_empty_cells", with_sql(*O, MIDNIGHT, select=six(times("night"))))
def time_stats_empty_cells(spark, sf):
    """All plays at midnight: three of four levels are empty and still reported."""
    plays = rows(spark, sf, "orders").withColumn("time_of_day", F.lit("Night"))
    return means6(A.time_stats(plays))


# --- summary ----------------------------------------------------------------------


@check(
    "dataset_overview",
    with_sql(
        *E,
        select="""SELECT count(*) AS total_records, min(timestamp) AS start,
  max(timestamp) AS "end", count(DISTINCT track_name) AS unique_tracks,
  count(DISTINCT artist_name) AS unique_artists, count(DISTINCT album_name) AS unique_albums
FROM events_rows""",
    ),
)
def dataset_overview(spark, sf):
    return A.dataset_overview(rows(spark, sf, "events"))


def _counts(column: str) -> str:
    return f"SELECT {column}, count(*) AS n FROM events_rows GROUP BY {column}"


@check("content_type_counts", with_sql(*E, select=_counts("content_type")))
def content_type_counts(spark, sf):
    return A.value_counts(rows(spark, sf, "events"), "content_type")


@check("mood_counts", with_sql(*E, select=_counts("mood")))
def mood_counts(spark, sf):
    return A.value_counts(rows(spark, sf, "events"), "mood")


@check("platform_counts", with_sql(*E, select=_counts("platform_category")))
def platform_counts(spark, sf):
    return A.value_counts(rows(spark, sf, "events"), "platform_category")


PER_PLAY = """per_play AS (
  SELECT *, CAST(sum(ms_played) OVER (PARTITION BY content_type, session_id) AS DOUBLE) / 60000
            AS session_duration_minutes FROM events_sessions)"""


@check(
    "listening_behavior",
    with_sql(
        *E,
        E_SESSIONS,
        PER_PLAY,
        select=f"""SELECT CAST(sum(ms_played) AS DOUBLE) / 3600000 AS total_listening_hours,
  {r("avg(session_duration_minutes)", "average_session_duration")},
  CAST(count(*) FILTER (is_skip) AS DOUBLE) / count(*) AS skip_rate,
  CAST(count(*) FILTER (is_complete_listen) AS DOUBLE) / count(*) AS completion_rate,
  {r("avg(listening_efficiency)", "average_listening_efficiency")}
FROM per_play""",
    ),
)
def listening_behavior(spark, sf):
    plays = rows(spark, sf, "events")
    return rounded(
        A.listening_behavior(plays, Q.session_stats(plays)),
        6,
        "average_session_duration",
        "average_listening_efficiency",
    )


@check(
    "audio_features_summary",
    with_sql(
        *E,
        select="SELECT "
        + ", ".join(r(f"avg({c})", f"average_{c}") for c in MEANS)
        + " FROM events_rows",
    ),
)
def audio_features_summary(spark, sf):
    out = A.audio_features_summary(rows(spark, sf, "events"))
    return rounded(out, 6, *out.columns)


@check(
    "summary_document",
    with_sql(
        *E,
        E_SESSIONS,
        PER_PLAY,
        select=f"""SELECT count(*) AS total_records, count(*) FILTER (content_type = 'music') AS music,
  count(*) FILTER (mood = 'Happy') AS happy,
  count(*) FILTER (platform_category = 'Mobile') AS mobile,
  {r("avg(tempo)", "average_tempo")},
  {r("avg(session_duration_minutes)", "average_session_duration")}
FROM per_play""",
    ),
)
def summary_document(spark, sf):
    """A few leaves of the nested document."""
    plays = rows(spark, sf, "events")
    doc = A.summary_document(plays, Q.session_stats(plays), play_cube(plays))
    leaves = {
        "total_records": "dataset_overview.total_records",
        "music": "dataset_overview.content_types.music",
        "happy": "audio_features_summary.mood_distribution.Happy",
        "mobile": "platform_usage.platform_distribution.Mobile",
        "average_tempo": "audio_features_summary.average_tempo",
        "average_session_duration": "listening_behavior.average_session_duration",
    }
    out = doc.select(*[F.col(path).alias(name) for name, path in leaves.items()])
    return rounded(out, 6, "average_tempo", "average_session_duration")


# --- days -------------------------------------------------------------------------

PATTERN = grouped("events_rows", "date, content_type", MS, PLAYS, DONE, SKIPS, RAW_MEANS)
PATTERN_DOW = f"SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM ({PATTERN})"
D = (*E, f"daily AS ({PATTERN_DOW})")
DOW_COLUMNS = ("listening_hours", "plays", "skip_rate", "completion_rate", "valence", "energy")
DOW = (
    "SELECT day_of_week, content_type, "
    + ", ".join(r(f"avg({c})", c, 9 if c == "listening_hours" else 6) for c in DOW_COLUMNS)
    + " FROM daily GROUP BY day_of_week, content_type"
)


def _daily(spark, sf):
    return P.daily_pattern_stats(rows(spark, sf, "events"))


def _dow(df):
    return rounded(rounded(df, 6, *DOW_COLUMNS[1:]), 9, "listening_hours")


@check("daily_pattern_stats", with_sql(*E, select=six(PATTERN_DOW)))
def daily_pattern_stats(spark, sf):
    return means6(_daily(spark, sf))


@check("day_of_week_stats", with_sql(*D, select=DOW))
def day_of_week_stats(spark, sf):
    return _dow(P.day_of_week_stats(_daily(spark, sf)))


@check("total_days", with_sql(*D, select="SELECT count(DISTINCT date) AS total_days FROM daily"))
def total_days(spark, sf):
    return P.day_totals(_daily(spark, sf))


def _mean_hours(table: str, name: str) -> str:
    return (
        f"SELECT content_type, {r('avg(listening_hours)', name, 9)} FROM {table} "
        "GROUP BY content_type"
    )


@check("average_daily_hours", with_sql(*D, select=_mean_hours("daily", "average_daily_hours")))
def average_daily_hours(spark, sf):
    means = P.mean_hours_by_type(_daily(spark, sf), "average_daily_hours")
    return rounded(means, 9, "average_daily_hours")


@check(
    "peak_day",
    with_sql(
        *D,
        f"dow AS ({DOW})",
        select="SELECT * FROM dow ORDER BY listening_hours DESC, day_of_week, content_type LIMIT 1",
    ),
)
def peak_day(spark, sf):
    return _dow(P.peak_day(P.day_of_week_stats(_daily(spark, sf))))


# --- weeks and months -------------------------------------------------------------

WK = (*O, O_SESSIONS, f"weekly AS ({WEEKLY_S})")
MO = (*O, O_SESSIONS, f"monthly AS ({MONTHLY})")


def _weekly(spark, sf):
    return A.weekly_stats_with_sessions(rows(spark, sf, "orders", sessions=True))


def _monthly(spark, sf):
    return A.monthly_stats(rows(spark, sf, "orders", sessions=True))


def _trends(table: str) -> str:
    return f"""SELECT content_type, {r("avg(listening_hours)", "hours_mean", 9)},
  {r("stddev_samp(listening_hours)", "hours_std")},
  min(listening_hours) AS hours_min, max(listening_hours) AS hours_max,
  {r("avg(unique_artists)", "unique_artists_mean")},
  {r("avg(total_sessions)", "total_sessions_mean")}
FROM {table} GROUP BY content_type"""


def _trends6(df):
    six_ = ("hours_std", "unique_artists_mean", "total_sessions_mean")
    return rounded(rounded(df, 6, *six_), 9, "hours_mean")


@check("weekly_pattern_stats", with_sql(*WK, select=six("SELECT * FROM weekly")))
def weekly_pattern_stats(spark, sf):
    return means6(_weekly(spark, sf))


@check("weekly_trends", with_sql(*WK, select=_trends("weekly")))
def weekly_trends(spark, sf):
    return _trends6(P.period_trends(_weekly(spark, sf)))


@check(
    "total_weeks",
    with_sql(*WK, select="SELECT count(DISTINCT week_of_year) AS total_weeks FROM weekly"),
)
def total_weeks(spark, sf):
    weekly = A.weekly_stats(rows(spark, sf, "orders"))
    return P.distinct_periods(weekly, "week_of_year", "total_weeks")


@check("average_weekly_hours", with_sql(*WK, select=_mean_hours("weekly", "average_weekly_hours")))
def average_weekly_hours(spark, sf):
    means = P.mean_hours_by_type(A.weekly_stats(rows(spark, sf, "orders")), "average_weekly_hours")
    return rounded(means, 9, "average_weekly_hours")


@check("monthly_trends", with_sql(*MO, select=_trends("monthly")))
def monthly_trends(spark, sf):
    return _trends6(P.period_trends(_monthly(spark, sf)))


@check(
    "peak_months",
    with_sql(
        *MO,
        select=six(
            """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (
  PARTITION BY content_type ORDER BY listening_hours DESC, year, month) AS k FROM monthly)
WHERE k = 1"""
        ),
    ),
)
def peak_months(spark, sf):
    return means6(P.peak_months(_monthly(spark, sf)))


@check(
    "total_months",
    with_sql(*MO, select="SELECT count(DISTINCT month) AS total_months FROM monthly"),
)
def total_months(spark, sf):
    monthly = A.rollup(rows(spark, sf, "orders"), A.MONTH)
    return P.distinct_periods(monthly, "month", "total_months")


# --- seasons and times of day -----------------------------------------------------

SE = (*O, f"seasons AS ({seasons('orders_rows')})")
TI = (*E, f"times AS ({times('events_rows')})")


def _seasons(spark, sf):
    return P.seasonal_stats(rows(spark, sf, "orders"))


def _times(spark, sf):
    return A.time_stats(rows(spark, sf, "events"))


def _peaks(table: str, level: str) -> str:
    return f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (
  PARTITION BY content_type ORDER BY listening_hours DESC, {level}_ord) AS k FROM {table})
WHERE k = 1"""


def _level_means(table: str, level: str) -> str:
    return (
        f"SELECT {level}, {level}_ord, "
        + ", ".join(r(f"avg({c})", c) for c in MEANS)
        + f" FROM {table} GROUP BY {level}, {level}_ord"
    )


def _favorite(table: str, level: str) -> str:
    return f"""SELECT {level}, listening_hours FROM {table}
ORDER BY listening_hours DESC, {level}_ord, content_type LIMIT 1"""


@check("seasonal_stats", with_sql(*SE, select=six("SELECT * FROM seasons")))
def seasonal_stats(spark, sf):
    return means6(_seasons(spark, sf))


@check(
    "seasonal_preferences",
    with_sql(*SE, select=f"SELECT content_type, season FROM ({_peaks('seasons', 'season')})"),
)
def seasonal_preferences(spark, sf):
    return P.peak_level(_seasons(spark, sf), "season").select("content_type", "season")


@check("seasonal_audio_features", with_sql(*SE, select=_level_means("seasons", "season")))
def seasonal_audio_features(spark, sf):
    return means6(P.level_audio_features(_seasons(spark, sf), "season"))


@check("favorite_season_cell", with_sql(*SE, select=_favorite("seasons", "season")))
def favorite_season_cell(spark, sf):
    return P.favorite_level(_seasons(spark, sf), "season")


@check("peak_times", with_sql(*TI, select=six(_peaks("times", "time_of_day"))))
def peak_times(spark, sf):
    return means6(P.peak_level(_times(spark, sf), "time_of_day"))


@check("time_audio_features", with_sql(*TI, select=_level_means("times", "time_of_day")))
def time_audio_features(spark, sf):
    return means6(P.level_audio_features(_times(spark, sf), "time_of_day"))


@check("favorite_time_cell", with_sql(*TI, select=_favorite("times", "time_of_day")))
def favorite_time_cell(spark, sf):
    return P.favorite_level(_times(spark, sf), "time_of_day")


# --- years ------------------------------------------------------------------------

YEARLY = grouped("orders_rows", "year, content_type", MS, PLAYS, *NAMES, RAW_MEANS)
YE = (*O, f"yearly AS ({YEARLY})")
GROWTH = """SELECT *, (listening_hours / nullif(lag(listening_hours) OVER (
  PARTITION BY content_type ORDER BY year), 0) - 1) * 100 AS growth_rate FROM yearly"""


def _yearly(spark, sf):
    return P.yearly_stats(rows(spark, sf, "orders"))


@check("yearly_stats", with_sql(*YE, select=six("SELECT * FROM yearly")))
def yearly_stats(spark, sf):
    return means6(_yearly(spark, sf))


@check("yearly_growth", with_sql(*YE, select=six(GROWTH, (*MEANS, "growth_rate"))))
def yearly_growth(spark, sf):
    return rounded(means6(P.yearly_growth(_yearly(spark, sf))), 6, "growth_rate")


@check(
    "overall_trends",
    with_sql(
        *YE,
        select=f"""SELECT year, {r("sum(listening_hours)", "listening_hours", 7)},
  {big("sum(unique_artists)", "unique_artists")}, {r("avg(valence)", "valence")},
  {r("avg(energy)", "energy")} FROM yearly GROUP BY year""",
    ),
)
def overall_trends(spark, sf):
    return rounded(means6(P.overall_trends(_yearly(spark, sf))), 7, "listening_hours")


@check(
    "year_totals",
    with_sql(
        *YE,
        select=f"""SELECT count(DISTINCT year) AS total_years,
  {r("avg(growth_rate)", "growth_rate")} FROM ({GROWTH})""",
    ),
)
def year_totals(spark, sf):
    return rounded(P.year_totals(P.yearly_growth(_yearly(spark, sf))), 6, "growth_rate")
