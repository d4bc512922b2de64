"""Filters, exploration datasets, report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.base import rows, rows_sql, sessions_sql, with_sql
from checks.registry import big, check, hours, r, rate, rounded
from checks.rollup_checks import (
    COUNTS,
    MS,
    PLAYS,
    SEASON_NAMES,
    TIMES,
    dense,
    grouped,
)
from playtrail.operators.rollup import name_cube, play_cube
from playtrail.plans import explore as V
from playtrail.plans import session_behavior as Q

E, O = rows_sql("events"), rows_sql("orders")
S = sessions_sql("events")
SESSIONS = """stats AS (
  SELECT content_type, session_id, count(*) AS n_rows,
         CAST(sum(ms_played) AS DOUBLE) / 60000 AS session_duration_minutes
  FROM events_sessions GROUP BY content_type, session_id)"""


def _events(spark, sf):
    return rows(spark, sf, "events")


def _orders(spark, sf):
    return rows(spark, sf, "orders")


# --- filters ----------------------------------------------------------------------


@check(
    "filter_plays",
    with_sql(
        *O,
        select="""SELECT play_id, date, content_type, platform_category, ms_played FROM orders_rows
WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-08-31'
  AND content_type = 'podcast' AND platform_category = 'Mobile'""",
    ),
)
def filter_plays(spark, sf):
    kept = V.filter_plays(_orders(spark, sf), "1996-03-01", date(1998, 8, 31), "podcast", "Mobile")
    return kept.select("play_id", "date", "content_type", "platform_category", "ms_played")


@check(
    "filter_options",
    with_sql(
        *O,
        select="""SELECT min(date) AS min_date, max(date) AS max_date,
  string_agg(DISTINCT content_type, '|' ORDER BY content_type) AS content_types,
  string_agg(DISTINCT platform_category, '|' ORDER BY platform_category) AS platforms
FROM orders_rows""",
    ),
)
def filter_options(spark, sf):
    options = V.filter_options(_orders(spark, sf))
    lists = ("content_types", "platforms")
    return options.withColumns({c: F.array_join(c, "|") for c in lists})


# --- overview ---------------------------------------------------------------------


@check(
    "kpis",
    with_sql(
        *E,
        select=f"""SELECT CAST(sum(ms_played) AS DOUBLE) / 3600000 AS total_hours,
  count(*) AS total_plays, count(DISTINCT artist_name) AS unique_artists,
  {r("avg(listening_efficiency)", "average_efficiency")} FROM events_rows""",
    ),
)
def kpis(spark, sf):
    return rounded(V.kpis(_events(spark, sf)), 6, "average_efficiency")


@check(
    "kpis_filtered",
    with_sql(
        *O,
        select=f"""SELECT CAST(sum(ms_played) AS DOUBLE) / 3600000 AS total_hours,
  count(*) AS total_plays, count(DISTINCT artist_name) AS unique_artists,
  {r("avg(listening_efficiency)", "average_efficiency")} FROM orders_rows
WHERE date >= DATE '1997-01-01' AND content_type = 'music'""",
    ),
)
def kpis_filtered(spark, sf):
    kept = V.filter_plays(_orders(spark, sf), start="1997-01-01", content_type="music")
    return rounded(V.kpis(kept), 6, "average_efficiency")


@check(
    "hours_by_content_type",
    with_sql(
        *E,
        select=f"SELECT content_type, {hours('sum(ms_played)')} FROM events_rows "
        "GROUP BY content_type",
    ),
)
def hours_by_content_type(spark, sf):
    return V.hours_by_content_type(_events(spark, sf))


@check(
    "top_artists_by_hours",
    with_sql(
        *O,
        select=f"""SELECT * FROM ({grouped("orders_rows", "artist_name", MS, PLAYS)})
ORDER BY listening_hours DESC, artist_name LIMIT 10""",
    ),
)
def top_artists_by_hours(spark, sf):
    return V.top_artists_by_hours(_orders(spark, sf))


# --- time -------------------------------------------------------------------------


@check("daily_hours", with_sql(*E, select=grouped("events_rows", "date, content_type", MS, PLAYS)))
def daily_hours(spark, sf):
    return V.daily_hours(_events(spark, sf))


@check(
    "hours_by_time_of_day",
    with_sql(
        *E,
        select=f"""SELECT *, {hours("ms_played")} FROM (
  SELECT l.time_of_day, l.time_of_day_ord, CAST(coalesce(sum(ms_played), 0) AS BIGINT) AS ms_played,
         count(track_name) AS plays
  FROM (VALUES ('Night', 0), ('Morning', 1), ('Afternoon', 2), ('Evening', 3))
       AS l(time_of_day, time_of_day_ord)
  LEFT JOIN events_rows e ON e.time_of_day = l.time_of_day
  GROUP BY l.time_of_day, l.time_of_day_ord)""",
    ),
)
def hours_by_time_of_day(spark, sf):
    return V.hours_by_time_of_day(_events(spark, sf))


HEATMAP = ", ".join(
    f"coalesce(CAST(sum(ms_played) FILTER (hour = {h}) AS DOUBLE), 0) / 3600000 AS h{h}"
    for h in range(24)
)


@check(
    "heatmap_hour_weekday",
    with_sql(*E, select=f"SELECT day_of_week, {HEATMAP} FROM events_rows GROUP BY day_of_week"),
)
def heatmap_hour_weekday(spark, sf):
    return V.hour_weekday_heatmap(_events(spark, sf))


@check(
    "hours_by_weekday",
    with_sql(*E, select=grouped("events_rows", "day_of_week, content_type", MS, PLAYS)),
)
def hours_by_weekday(spark, sf):
    return V.hours_by_weekday(_events(spark, sf))


@check(
    "hours_by_season",
    with_sql(
        *E,
        select=f"SELECT *, {hours('ms_played')} "
        f"FROM ({dense('events_rows', 'season', SEASON_NAMES, COUNTS, {})})",
    ),
)
def hours_by_season(spark, sf):
    """All plays lie in January: three seasons are empty."""
    return V.hours_by_season(_events(spark, sf))


@check(
    "plays_by_hour",
    with_sql(*E, select="SELECT hour, count(*) AS n FROM events_rows GROUP BY hour"),
)
def plays_by_hour(spark, sf):
    return V.plays_by_hour(_events(spark, sf))


@check(
    "plays_by_weekday",
    with_sql(
        *E,
        select="""SELECT day_of_week, dayname(timestamp) AS day_name, count(*) AS n
FROM events_rows GROUP BY ALL""",
    ),
)
def plays_by_weekday(spark, sf):
    return V.plays_by_weekday(_events(spark, sf))


@check(
    "yearly_trend", with_sql(*O, select=grouped("orders_rows", "year, content_type", MS, PLAYS))
)
def yearly_trend(spark, sf):
    return V.yearly_trend(_orders(spark, sf))


@check(
    "platform_hours_by_year",
    with_sql(*O, select=grouped("orders_rows", "year, platform_category", MS)),
)
def platform_hours_by_year(spark, sf):
    return V.platform_hours_by_year(_orders(spark, sf))


# --- behaviour --------------------------------------------------------------------


def _histogram(source: str, value: str, n: str) -> str:
    return f"""SELECT bin, {r("lo + (hi - lo) / 30 * (bin - 1)", "bin_start")},
  {r("lo + (hi - lo) / 30 * bin", "bin_end")}, CAST({n} AS BIGINT) AS n
FROM (SELECT *, CAST(CASE WHEN hi = lo THEN 1
                     ELSE least(floor((x - lo) / (hi - lo) * 30) + 1, 30) END AS INTEGER) AS bin
      FROM (SELECT {value} AS x, * FROM {source}),
           (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}))
WHERE x IS NOT NULL GROUP BY bin, lo, hi"""


def _bins6(df):
    return rounded(df, 6, "bin_start", "bin_end")


@check(
    "session_minutes_histogram",
    with_sql(
        *E, S, SESSIONS, select=_histogram("stats", "session_duration_minutes", "sum(n_rows)")
    ),
)
def session_minutes_histogram(spark, sf):
    return _bins6(V.session_minutes_histogram(Q.session_stats(_events(spark, sf))))


@check(
    "session_minutes_histogram_per_session",
    with_sql(*E, S, SESSIONS, select=_histogram("stats", "session_duration_minutes", "count(*)")),
)
def session_minutes_histogram_per_session(spark, sf):
    sessions = Q.session_stats(_events(spark, sf))
    return _bins6(V.session_minutes_histogram(sessions, per="session"))


@check(
    "session_minutes_by_type",
    with_sql(
        *E,
        S,
        select=f"""SELECT content_type, {r("avg(m)", "session_duration_minutes")}
FROM (SELECT content_type, CAST(sum(ms_played) OVER (PARTITION BY content_type, session_id)
             AS DOUBLE) / 60000 AS m FROM events_sessions)
GROUP BY content_type""",
    ),
)
def session_minutes_by_type(spark, sf):
    means = V.session_minutes_by_type(Q.session_stats(_events(spark, sf)))
    return rounded(means, 6, "session_duration_minutes")


@check(
    "efficiency_histogram",
    with_sql(*E, select=_histogram("events_rows", "listening_efficiency", "count(*)")),
)
def efficiency_histogram(spark, sf):
    return _bins6(V.efficiency_histogram(_events(spark, sf)))


@check(
    "efficiency_by_platform",
    with_sql(
        *E,
        select=f"""SELECT platform_category, {r("avg(listening_efficiency)", "listening_efficiency")}
FROM events_rows GROUP BY platform_category""",
    ),
)
def efficiency_by_platform(spark, sf):
    return rounded(V.efficiency_by_platform(_events(spark, sf)), 6, "listening_efficiency")


SKIP_CELLS = dense(
    "events_rows",
    "time_of_day",
    TIMES,
    {"skips": "count(*) FILTER (is_skip)", "plays": "count(track_name)"},
    {},
)


@check(
    "skip_rate_by_type_and_time",
    with_sql(*E, select=f"SELECT *, {rate('skips', 'plays', 'skip_rate')} FROM ({SKIP_CELLS})"),
)
def skip_rate_by_type_and_time(spark, sf):
    return V.skip_rate_by_type_and_time(_events(spark, sf))


# --- headlines --------------------------------------------------------------------

TOP_ARTIST = f"""SELECT * FROM ({grouped("orders_rows", "artist_name", MS)})
ORDER BY ms_played DESC, artist_name LIMIT 1"""
PEAK_TIME = f"""SELECT * FROM ({grouped("orders_rows", "time_of_day", MS)}) ORDER BY ms_played DESC,
CASE time_of_day WHEN 'Night' THEN 0 WHEN 'Morning' THEN 1 WHEN 'Afternoon' THEN 2 ELSE 3 END
LIMIT 1"""
BEST_SEASON = f"""SELECT * FROM ({grouped("orders_rows", "season", MS)}) ORDER BY ms_played DESC,
CASE season WHEN 'Winter' THEN 0 WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 ELSE 3 END LIMIT 1"""


@check("top_artist", with_sql(*O, select=TOP_ARTIST))
def top_artist(spark, sf):
    return V.top_artist(_orders(spark, sf))


@check("peak_time", with_sql(*O, select=PEAK_TIME))
def peak_time(spark, sf):
    return V.peak_time(_orders(spark, sf))


@check("favorite_season", with_sql(*O, select=BEST_SEASON))
def favorite_season(spark, sf):
    return V.favorite_season(_orders(spark, sf))


@check(
    "key_insight_lines",
    with_sql(
        *O,
        select=f"""SELECT 1 AS ord, format('Total Listening Time: {{:.1f}} hours',
    CAST(sum(ms_played) AS DOUBLE) / 3600000) AS line FROM orders_rows
UNION ALL SELECT 2, format('Top Artist: {{}} ({{:.1f}} hours)', artist_name, listening_hours)
  FROM ({TOP_ARTIST})
UNION ALL SELECT 3, 'Peak Listening Time: ' || time_of_day FROM ({PEAK_TIME})
UNION ALL SELECT 4, 'Favorite Season: ' || season FROM ({BEST_SEASON})
UNION ALL SELECT 5, format('Average Listening Efficiency: {{:.1f}}%',
    avg(listening_efficiency) * 100) FROM orders_rows""",
    ),
)
def key_insight_lines(spark, sf):
    plays = _orders(spark, sf)
    return V.key_insight_lines(play_cube(plays), name_cube(plays))


def _shares(column: str, section: int, title: str) -> str:
    return f"""SELECT {section} AS section_ord, 0 AS ord, '{title}' AS line
UNION ALL SELECT {section}, CAST(row_number() OVER (ORDER BY n DESC, {column}) AS INTEGER),
  format('- {{}}: {{:,}} tracks ({{:.1f}}%)', {column}, n, 100.0::DOUBLE * n / sum(n) OVER ())
FROM (SELECT {column}, count(*) AS n FROM orders_rows GROUP BY {column})"""


@check(
    "summary_report",
    with_sql(
        *O,
        """facts AS (SELECT CAST(sum(ms_played) AS DOUBLE) / 3600000 AS h, count(*) AS n,
                  count(DISTINCT artist_name) AS a FROM orders_rows)""",
        select=f"""SELECT 0 AS section_ord, 0 AS ord, 'Play history report' AS line
UNION ALL SELECT 0, 1, repeat('=', 19)
UNION ALL SELECT unnest([1, 2, 3, 4]), -1, ''
UNION ALL SELECT 1 AS section_ord, 0 AS ord, 'BASIC STATISTICS:' AS line
UNION ALL SELECT 1, 1, format('- Total Listening Hours: {{:.1f}}', h) FROM facts
UNION ALL SELECT 1, 2, format('- Total Tracks Played: {{:,}}', n) FROM facts
UNION ALL SELECT 1, 3, format('- Unique Artists: {{:,}}', a) FROM facts
UNION ALL {_shares("content_type", 2, "CONTENT TYPE BREAKDOWN:")}
UNION ALL SELECT 3, 0, 'TOP 5 ARTISTS:'
UNION ALL (SELECT 3, CAST(k AS INTEGER), format('{{}}. {{}}: {{:.1f}} hours', k, artist_name, h)
  FROM (SELECT artist_name, CAST(sum(ms_played) AS DOUBLE) / 3600000 AS h,
          row_number() OVER (ORDER BY sum(ms_played) DESC, artist_name) AS k
        FROM orders_rows GROUP BY artist_name) WHERE k <= 5)
UNION ALL {_shares("platform_category", 4, "PLATFORM USAGE:")}""",
    ),
)
def summary_report(spark, sf):
    return V.summary_report(_orders(spark, sf))
