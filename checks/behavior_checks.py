"""Sessions, clusters, platforms, efficiency, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import rows, rows_sql, sessions_sql, with_sql
from checks.registry import big, check, hours, r, rate, rounded
from checks.rollup_checks import (
    AVERAGES,
    COUNTS,
    DOW,
    MS,
    PATTERN_DOW,
    PLAYS,
    SEASON_NAMES,
    SKIPS,
    TIMES,
    DONE,
    dense,
    grouped,
    six,
)
from playtrail.operators.rollup import name_cube, play_cube
from playtrail.plans import clustering
from playtrail.plans import efficiency as E
from playtrail.plans import insights as N
from playtrail.plans import platform as L
from playtrail.plans import rollups as A
from playtrail.plans import session_behavior as Q
from playtrail.plans import temporal as P
from playtrail.session import materialize

ROWS, S = rows_sql("events"), sessions_sql("events")
EFF = "avg(listening_efficiency) AS listening_efficiency"

SESSION_STATS = f"""SELECT *, CAST(session_duration AS DOUBLE) / 60000 AS session_duration_minutes,
  {rate("skips", "tracks_in_session", "skip_rate")},
  {rate("completes", "tracks_in_session", "completion_rate")}
FROM (SELECT content_type, session_id, {big("sum(ms_played)", "session_duration")},
        count(track_name) AS tracks_in_session, count(*) AS n_rows,
        min(timestamp) AS session_start, max(timestamp) AS session_end,
        {r("avg(valence)", "avg_valence")}, {r("avg(energy)", "avg_energy")},
        {r("avg(danceability)", "avg_danceability")}, {SKIPS}, {DONE}
      FROM events_sessions GROUP BY content_type, session_id)"""
ST = (*ROWS, S, f"stats AS ({SESSION_STATS})")


def _sessions(spark, sf):
    return Q.session_stats(rows(spark, sf, "events"))


# --- sessions ---------------------------------------------------------------------


@check("session_stats", with_sql(*ST, select="SELECT * FROM stats"))
def session_stats(spark, sf):
    return rounded(_sessions(spark, sf), 6, "avg_valence", "avg_energy", "avg_danceability")


@check(
    "session_patterns",
    with_sql(
        *ST,
        select=f"""SELECT content_type, {r("avg(session_duration_minutes)", "minutes_mean")},
  {r("stddev_samp(session_duration_minutes)", "minutes_std")},
  min(session_duration_minutes) AS minutes_min, max(session_duration_minutes) AS minutes_max,
  {r("avg(tracks_in_session)", "tracks_mean")},
  {r("stddev_samp(tracks_in_session)", "tracks_std")},
  {r("avg(skip_rate)", "skip_rate")}, {r("avg(completion_rate)", "completion_rate")},
  {r("median(session_duration_minutes)", "minutes_median")},
  {r("median(tracks_in_session)", "tracks_median")}
FROM stats GROUP BY content_type""",
    ),
)
def session_patterns(spark, sf):
    out = Q.session_patterns(_sessions(spark, sf))
    fixed = ("content_type", "minutes_min", "minutes_max")
    return rounded(out, 6, *[c for c in out.columns if c not in fixed])


@check(
    "binge_sessions",
    with_sql(
        *ST,
        select=f"""SELECT count(*) FILTER (session_duration_minutes > 60) AS count,
  {r("count(*) FILTER (session_duration_minutes > 60) * 100.0::DOUBLE / count(*)", "percentage")},
  {r("avg(session_duration_minutes) FILTER (session_duration_minutes > 60)", "average_duration")}
FROM stats""",
    ),
)
def binge_sessions(spark, sf):
    return rounded(Q.binge_sessions(_sessions(spark, sf)), 6, "percentage", "average_duration")


@check(
    "session_totals",
    with_sql(
        *ST,
        select=f"""SELECT count(*) AS total_sessions,
  {r("avg(session_duration_minutes)", "average_session_duration")} FROM stats""",
    ),
)
def session_totals(spark, sf):
    return rounded(Q.session_totals(_sessions(spark, sf)), 6, "average_session_duration")


# --- clusters: iterative, so SQL states what must hold of any outcome ---------------

def _clustered(spark, sf):
    """Clusters of the stored session table."""
    return clustering.cluster_sessions(materialize(_sessions(spark, sf), "sessions"))


@check(
    "cluster_sessions",
    with_sql(
        *ST,
        select="SELECT content_type, session_id, "
        + ", ".join(
            f"round(coalesce({c}, 0)::DOUBLE, 6) AS {c}" for c in clustering.CLUSTER_FEATURES
        )
        + ", true AS labelled, true AS nearest FROM stats",
    ),
)
def cluster_sessions(spark, sf):
    """Every session comes back with its features and a label that fits its number; no
    cluster's mean is nearer than that of its own."""
    labels = F.array(*[F.lit(label) for label in clustering.CLUSTER_LABELS])
    clustered = materialize(_clustered(spark, sf), "clustered")
    features = clustering.CLUSTER_FEATURES
    spread = clustered.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in features])).scalar()
    means = clustering.cluster_analysis(clustered).select("cluster", *features)
    means = means.agg(F.collect_list(F.struct(*means.columns))).scalar()

    def distance(mean):
        return sum(
            (F.coalesce(F.pow((F.col(c) - mean[c]) / F.nullif(F.col("spread")[c], F.lit(0.0)), F.lit(2)), F.lit(0.0)) for c in features),
            F.lit(0.0),
        )

    clustered = clustered.withColumns({"spread": spread, "means": means})
    ordered = F.array_min(F.transform("means", lambda m: F.struct(F.round(distance(m), 6), m["cluster"] != F.col("cluster"))))
    clustered = clustered.select(
        "content_type",
        "session_id",
        *features,
        (F.get(labels, F.col("cluster")) == F.col("cluster_type")).alias("labelled"),
        (~ordered.getField("col2")).alias("nearest"),
    )
    return rounded(clustered, 6, *clustering.CLUSTER_FEATURES)


@check(
    "cluster_analysis",
    with_sql(
        *ST,
        select="SELECT "
        + ", ".join(
            f"round(avg(coalesce({c}, 0)), 6) AS {c}" for c in clustering.CLUSTER_FEATURES
        )
        + ", true AS longest_is_long FROM stats",
    ),
)
def cluster_analysis(spark, sf):
    """Cluster means weighted by size are the means of all sessions; the cluster with the
    longest sessions is called so."""
    clustered = materialize(_clustered(spark, sf), "clustered")
    means = clustering.cluster_analysis(clustered)
    weighed = means.join(clustering.cluster_distribution(clustered), "cluster")
    longest = F.max_by("cluster_type", "session_duration_minutes") == clustering.CLUSTER_LABELS[1]
    out = weighed.agg(
        *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in clustering.CLUSTER_FEATURES],
        longest.alias("longest_is_long"),
    )
    return rounded(out, 6, *clustering.CLUSTER_FEATURES)


@check(
    "cluster_distribution",
    with_sql(
        *ST,
        select="SELECT count(*) AS sessions, least(4, count(DISTINCT ("
        + ", ".join(f"coalesce({c}, 0)" for c in clustering.CLUSTER_FEATURES)
        + "))) AS clusters FROM stats",
    ),
)
def cluster_distribution(spark, sf):
    """Cluster sizes add up to the number of sessions."""
    sizes = clustering.cluster_distribution(_clustered(spark, sf))
    return sizes.agg(F.sum("n").alias("sessions"), F.count("*").alias("clusters"))


# --- platforms --------------------------------------------------------------------

PLATFORM = grouped(
    "events_sessions",
    "platform_category, content_type",
    MS,
    PLAYS,
    SKIPS,
    DONE,
    "avg(valence) AS valence, avg(energy) AS energy, avg(danceability) AS danceability",
    "count(DISTINCT session_id) AS total_sessions",
)
PL = (*ROWS, S, f"stats AS ({PLATFORM})")
THREE = ("valence", "energy", "danceability")
EVOLUTION = grouped("orders_rows", "year, platform_category", MS, PLAYS)


def _platforms(spark, sf):
    return A.platform_stats(rows(spark, sf, "events", sessions=True))


@check("platform_stats", with_sql(*PL, select=six("SELECT * FROM stats", THREE)))
def platform_stats(spark, sf):
    return rounded(_platforms(spark, sf), 6, *THREE)


@check(
    "platform_preferences",
    with_sql(
        *PL,
        select="""SELECT content_type, platform_category FROM (SELECT *, row_number() OVER (
  PARTITION BY content_type ORDER BY listening_hours DESC, platform_category) AS k FROM stats)
WHERE k = 1""",
    ),
)
def platform_preferences(spark, sf):
    return L.platform_preferences(_platforms(spark, sf))


@check("platform_evolution", with_sql(*rows_sql("orders"), select=EVOLUTION))
def platform_evolution(spark, sf):
    return L.platform_evolution(rows(spark, sf, "orders"))


@check(
    "total_platforms",
    with_sql(*PL, select="SELECT count(DISTINCT platform_category) AS total_platforms FROM stats"),
)
def total_platforms(spark, sf):
    return L.platform_totals(_platforms(spark, sf))


@check(
    "most_used_platform",
    with_sql(
        *PL,
        select="""SELECT platform_category, listening_hours FROM stats
ORDER BY listening_hours DESC, platform_category, content_type LIMIT 1""",
    ),
)
def most_used_platform(spark, sf):
    return L.most_used_platform(_platforms(spark, sf))


# --- efficiency -------------------------------------------------------------------


@check(
    "efficiency_stats",
    with_sql(
        *ROWS,
        select=f"""SELECT *, {rate("total_skips", "total_tracks", "skip_rate")},
  {rate("total_completes", "total_tracks", "completion_rate")}
FROM (SELECT content_type, {r("avg(listening_efficiency)", "avg_efficiency")},
        {r("median(listening_efficiency)", "median_efficiency")},
        {r("stddev_samp(listening_efficiency)", "std_efficiency")},
        count(*) FILTER (is_skip) AS total_skips,
        count(*) FILTER (is_complete_listen) AS total_completes,
        count(track_name) AS total_tracks
      FROM events_rows GROUP BY content_type)""",
    ),
)
def efficiency_stats(spark, sf):
    out = E.efficiency_stats(rows(spark, sf, "events"))
    return rounded(out, 6, "avg_efficiency", "median_efficiency", "std_efficiency")


def _eff6(df):
    return rounded(df, 6, "listening_efficiency")


EFF6 = ("listening_efficiency",)
TIME_EFFICIENCY = dense(
    "events_rows",
    "time_of_day",
    TIMES,
    {"skips": "count(*) FILTER (is_skip)", "plays": "count(track_name)"},
    {"listening_efficiency": "avg(listening_efficiency)"},
)


@check(
    "time_efficiency",
    with_sql(
        *ROWS,
        select=six(f"SELECT *, {rate('skips', 'plays', 'skip_rate')} FROM ({TIME_EFFICIENCY})", EFF6),
    ),
)
def time_efficiency(spark, sf):
    return _eff6(E.time_efficiency(rows(spark, sf, "events")))


@check(
    "feature_efficiency",
    with_sql(*ROWS, select=six(grouped("events_rows", "mood", SKIPS, PLAYS, EFF), EFF6)),
)
def feature_efficiency(spark, sf):
    return _eff6(E.feature_efficiency(rows(spark, sf, "events")))


ARTISTS = grouped("events_rows", "artist_name", SKIPS, PLAYS, MS, EFF)
AR = (*ROWS, f"artists AS ({ARTISTS})")


def _artists(spark, sf):
    return E.artist_efficiency(rows(spark, sf, "events"))


@check("artist_efficiency", with_sql(*AR, select=six("SELECT * FROM artists", EFF6)))
def artist_efficiency(spark, sf):
    return _eff6(_artists(spark, sf))


@check("artist_efficiency_from_cube", with_sql(*AR, select=six("SELECT * FROM artists", EFF6)))
def artist_efficiency_from_cube(spark, sf):
    return _eff6(E.artist_efficiency(name_cube(rows(spark, sf, "events"))))


@check(
    "top_efficient_artists",
    with_sql(
        *AR,
        select=six(
            "SELECT * FROM artists ORDER BY listening_efficiency DESC, artist_name LIMIT 10", EFF6
        ),
    ),
)
def top_efficient_artists(spark, sf):
    return _eff6(E.top_efficient_artists(_artists(spark, sf)))


@check(
    "bottom_efficient_artists",
    with_sql(
        *AR,
        select=six(
            "SELECT * FROM artists ORDER BY listening_efficiency, artist_name LIMIT 10", EFF6
        ),
    ),
)
def bottom_efficient_artists(spark, sf):
    return _eff6(E.bottom_efficient_artists(_artists(spark, sf)))


OVERALL = f"""SELECT avg(listening_efficiency) AS overall_efficiency,
  CAST(count(*) FILTER (is_skip) AS DOUBLE) / count(*) AS overall_skip_rate FROM events_rows"""


@check("overall_efficiency", with_sql(*ROWS, select=six(OVERALL, ("overall_efficiency",))))
def overall_efficiency(spark, sf):
    return rounded(E.overall_efficiency(rows(spark, sf, "events")), 6, "overall_efficiency")


# --- insights ---------------------------------------------------------------------


def _line(category: str, ord_: int, text: str, source: str) -> str:
    return f"SELECT '{category}' AS category, {ord_} AS ord, {text} AS insight FROM ({source})"


TIME_CELLS = f"SELECT *, {hours('ms_played')} FROM ({dense('events_rows', 'time_of_day', TIMES, COUNTS, {})})"
SEASON_CELLS = f"SELECT *, {hours('ms_played')} FROM ({dense('events_rows', 'season', SEASON_NAMES, COUNTS, {})})"
INSIGHT_LINES = [
    _line(
        "temporal_insights",
        1,
        "format('Peak listening day: {} with {:.1f} hours', day_of_week, listening_hours)",
        f"SELECT * FROM ({DOW}) ORDER BY listening_hours DESC, day_of_week, content_type LIMIT 1",
    ),
    _line(
        "temporal_insights",
        2,
        "'Favorite listening season: ' || season",
        f"SELECT * FROM ({SEASON_CELLS}) ORDER BY listening_hours DESC, season_ord, content_type "
        "LIMIT 1",
    ),
    _line(
        "temporal_insights",
        3,
        "'Peak listening time: ' || time_of_day",
        f"SELECT * FROM ({TIME_CELLS}) ORDER BY listening_hours DESC, time_of_day_ord, content_type "
        "LIMIT 1",
    ),
    _line(
        "session_insights",
        1,
        "format('Average session duration: {:.1f} minutes', m)",
        "SELECT avg(session_duration_minutes) AS m FROM stats",
    ),
    _line(
        "session_insights",
        2,
        "format('Binge listening sessions: {} ({:.1f}%)', n, 100.0::DOUBLE * n / total)",
        "SELECT count(*) FILTER (session_duration_minutes > 60) AS n, count(*) AS total FROM stats",
    ),
    _line(
        "platform_insights",
        1,
        "'Most used platform: ' || platform_category",
        f"SELECT * FROM ({PLATFORM}) ORDER BY listening_hours DESC, platform_category, content_type "
        "LIMIT 1",
    ),
    _line(
        "efficiency_insights",
        1,
        "format('Overall listening efficiency: {:.1f}%', overall_efficiency * 100)",
        OVERALL,
    ),
    _line(
        "efficiency_insights",
        2,
        "format('Overall skip rate: {:.1f}%', overall_skip_rate * 100)",
        OVERALL,
    ),
]


@check(
    "insights",
    with_sql(*ST, f"daily AS ({PATTERN_DOW})", select=" UNION ALL ".join(INSIGHT_LINES)),
)
def insights(spark, sf):
    """All sentences from one play cube and one session table, each stored once."""
    plays = rows(spark, sf, "events")
    cube = materialize(play_cube(plays), "play_cube")
    sessions = materialize(Q.session_stats(plays), "sessions")
    seasons = A.rollup(cube, ["season", "content_type"], dense="season")
    results = {
        "temporal_patterns": {
            "peak_day": P.peak_day(P.day_of_week_stats(P.daily_pattern_stats(cube))),
            "favorite_season": P.favorite_level(seasons, "season"),
            "favorite_time": P.favorite_level(A.time_stats(cube), "time_of_day"),
        },
        "session_behavior": {
            "session_totals": Q.session_totals(sessions),
            "binge_sessions": Q.binge_sessions(sessions),
        },
        "platform_usage": {
            "most_used_platform": L.most_used_platform(
                A.rollup(cube, ["platform_category", "content_type"])
            )
        },
        "listening_efficiency": {"overall": E.overall_efficiency(cube)},
    }
    return N.generate_insights(results)
