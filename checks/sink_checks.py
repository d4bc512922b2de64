"""Write, read back, compare."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.adapters import audio_features, plays_from_orders
from checks.base import rows, rows_sql, with_sql
from checks.registry import ORACLES, QUERIES, check, r, rounded
from checks.ingest_checks import SOURCE_SQL, whole_files
from checks.rollup_checks import DAILY6, E_SESSIONS, PER_PLAY, means6
from playtrail.operators.rollup import play_cube
from playtrail.plans import explore, pipeline, rollups
from playtrail.plans import session_behavior as behavior
from playtrail.schema import AUDIO_MEANS
from playtrail.session import materialize, work_folder
from playtrail.sinks import writers
from playtrail.sinks.layout import INSIGHTS, SUMMARY
from playtrail.sources.tables import load_enriched

E, O = rows_sql("events"), rows_sql("orders")


def _folder(spark) -> str:
    return f"{work_folder(spark)}/sink-{uuid.uuid4().hex}"


_STORED = (
    "play_id, timestamp, track_name, artist_name, album_name, ms_played, skipped, platform, "
    "content_type, date, year, month, hour, day_of_week, week_of_year, time_of_day, day_type, season, "
    "is_skip, is_complete_listen, listening_duration_minutes, platform_category, mood, energy_level, "
    "danceability_level, tempo_category, inferred_genre, is_music, valence, tempo"
)


@check("sink_enriched_plays", with_sql(*O, select=f"SELECT {_STORED} FROM orders_rows"))
def sink_enriched_plays(spark, sf):
    """All stored plays."""
    out = _folder(spark)
    writers.write_enriched(rows(spark, sf, "orders"), out)
    return load_enriched(spark, out).plays.select(*_STORED.split(", "))


@check(
    "sink_enriched_filtered",
    with_sql(
        *O,
        select="""SELECT play_id, date, year, season, mood, listening_efficiency FROM orders_rows
WHERE year = 1997 AND date <= DATE '1997-06-30' AND content_type = 'music'""",
    ),
)
def sink_enriched_filtered(spark, sf):
    """Filters on the stored table prune its year directories."""
    out = _folder(spark)
    writers.write_enriched(rows(spark, sf, "orders"), out)
    stored = load_enriched(spark, out).plays
    kept = explore.filter_plays(stored, "1997-01-01", "1997-06-30", "music")
    return kept.select("play_id", "date", "year", "season", "mood", "listening_efficiency")


def _stored_rollup(name: str):
    """The rollup's checked rows, written next to the plays and found again by name."""

    def query(spark, sf):
        out = _folder(spark)
        writers.write_enriched(rows(spark, sf, "events"), out)
        writers.write_tables({name: QUERIES[name](spark, sf)}, out)
        return load_enriched(spark, out).rollups[name]

    return query


for _name in ("daily_stats", "weekly_stats", "monthly_stats", "artist_stats", "time_stats"):
    check(f"sink_{_name}", ORACLES[_name])(_stored_rollup(_name))
check("sink_rollups", ORACLES["daily_stats"])(_stored_rollup("daily_stats"))


def leaves(document):
    """A one-row nested document as ``(leaf, value)``, times in microseconds."""
    entries = []

    def walk(path, kind):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk((*path, f.name), f.dataType)
        elif isinstance(kind, T.MapType):
            named = F.transform_keys(F.col(".".join(path)), lambda k, v: F.concat(F.lit(".".join(path) + "."), k))
            entries.append(F.transform_values(named, lambda k, v: v.cast("double")))
        else:
            value = F.col(".".join(path))
            value = F.unix_micros(value) if isinstance(kind, T.TimestampType) else value
            entries.append(F.create_map(F.lit(".".join(path)), value.cast("double")))

    walk((), document.schema)
    return rounded(document.select(F.explode(F.map_concat(*entries)).alias("leaf", "value")), 6, "value")


def _counts(path: str, column: str) -> str:
    return f"SELECT '{path}.' || {column}, count(*)::DOUBLE FROM per_play WHERE {column} IS NOT NULL GROUP BY {column}"


SUMMARY_LEAVES = {
    "dataset_overview.total_records": "count(*)",
    "dataset_overview.date_range.start": "epoch_us(min(timestamp))",
    "dataset_overview.date_range.end": "epoch_us(max(timestamp))",
    **{f"dataset_overview.unique_{x}s": f"count(DISTINCT {x}_name)" for x in ("track", "artist", "album")},
    "listening_behavior.total_listening_hours": "sum(ms_played) / 3600000.0::DOUBLE",
    "listening_behavior.average_session_duration": "avg(session_duration_minutes)",
    "listening_behavior.skip_rate": "count(*) FILTER (is_skip) / count(*)::DOUBLE",
    "listening_behavior.completion_rate": "count(*) FILTER (is_complete_listen) / count(*)::DOUBLE",
    "listening_behavior.average_listening_efficiency": "avg(listening_efficiency)",
    **{f"audio_features_summary.average_{c}": f"avg({c})" for c in AUDIO_MEANS},
}
SUMMARY_SQL = with_sql(
    *E,
    E_SESSIONS,
    PER_PLAY,
    select="SELECT leaf, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS leaf, CAST({sql} AS DOUBLE) AS value FROM per_play" for n, sql in SUMMARY_LEAVES.items())
    + "".join(
        f" UNION ALL {_counts(path, column)}"
        for path, column in (
            ("dataset_overview.content_types", "content_type"),
            ("audio_features_summary.mood_distribution", "mood"),
            ("platform_usage.platform_distribution", "platform_category"),
        )
    )
    + ")",
)


def _summary(spark, sf):
    plays = rows(spark, sf, "events")
    return rollups.summary_document(plays, behavior.session_stats(plays), play_cube(plays))


@check("summary_leaves", SUMMARY_SQL)
def summary_leaves(spark, sf):
    """Every leaf of the summary."""
    return leaves(_summary(spark, sf))


@check("sink_summary", SUMMARY_SQL)
def sink_summary(spark, sf):
    """Every leaf of the stored summary; JSON has no times, so their texts are read as such."""
    out = _folder(spark)
    document = _summary(spark, sf)
    writers.write_summary(document, out)
    return leaves(spark.read.schema(document.schema).json(f"{out}/{SUMMARY}"))


#: Tables of the four analyses that have a check of their own.
RESULTS = {
    "temporal_patterns": (
        "daily_pattern_stats", "day_of_week_stats", "average_daily_hours", "peak_day", "weekly_pattern_stats",
        "weekly_trends", "total_weeks", "monthly_stats", "monthly_trends", "peak_months", "total_months",
        "seasonal_stats", "seasonal_preferences", "seasonal_audio_features", "time_stats", "peak_times",
        "time_audio_features", "yearly_stats", "yearly_growth", "overall_trends", "year_totals",
    ),
    "session_behavior": ("session_stats", "session_patterns", "binge_sessions", "session_totals"),
    "platform_usage": ("platform_stats", "platform_preferences", "platform_evolution", "most_used_platform"),
    "listening_efficiency": (
        "efficiency_stats", "time_efficiency", "feature_efficiency", "artist_efficiency",
        "top_efficient_artists", "overall_efficiency",
    ),
}


def _stored_result(analysis: str, name: str):
    """The result's checked rows as JSON, read back as a table."""

    def query(spark, sf):
        out = _folder(spark)
        table = QUERIES[name](spark, sf)
        writers.write_results({analysis: {name: table}}, out)
        return spark.read.schema(table.schema).json(f"{out}/{analysis}_results.json/{name}")

    return query


for _analysis, _tables in RESULTS.items():
    for _name in _tables:
        check(f"sink_result_{_name}", ORACLES[_name])(_stored_result(_analysis, _name))


@check("sink_results", with_sql(*E, select=DAILY6))
def sink_results(spark, sf):
    """Analysis tables as JSON that can be read back as tables."""
    out = _folder(spark)
    daily = means6(rollups.daily_stats(rows(spark, sf, "events")))
    writers.write_results({"temporal_patterns": {"daily_stats": daily}}, out)
    return spark.read.schema(daily.schema).json(f"{out}/temporal_patterns_results.json/daily_stats")


@check(
    "sink_insights",
    f"SELECT * REPLACE (CAST(ord AS BIGINT) AS ord) FROM ({ORACLES['insights']})",
)
def sink_insights(spark, sf):
    """All four categories."""
    out = _folder(spark)
    return spark.read.json(writers.write_insights(QUERIES["insights"](spark, sf), out))


@check(
    "sink_csv",
    with_sql(
        *O,
        select="""SELECT play_id, artist_name, ms_played, platform_category FROM orders_rows
WHERE platform_category = 'Desktop'""",
    ),
)
def sink_csv(spark, sf):
    out = _folder(spark)
    kept = explore.filter_plays(rows(spark, sf, "orders"), platform="Desktop")
    columns = ["play_id", "artist_name", "ms_played", "platform_category"]
    writers.write_csv(kept.select(*columns), out)
    schema = "play_id bigint, artist_name string, ms_played bigint, platform_category string"
    return spark.read.schema(schema).option("header", True).csv(out)


@check("sink_report", f"SELECT line AS value FROM ({ORACLES['summary_report']})")
def sink_report(spark, sf):
    out = _folder(spark)
    writers.write_report(explore.summary_report(rows(spark, sf, "orders")), out)
    return spark.read.text(out)


_RAW = "plays_orders p LEFT JOIN features f ON p.track_uri = f.track_id CROSS JOIN medians m"


@check(
    "pipeline_enrich",
    with_sql(
        *O[:3],
        "medians AS (SELECT median(valence) AS v, median(duration_ms) AS d FROM plays_orders p "
        "LEFT JOIN features f ON p.track_uri = f.track_id)",
        select=f"""SELECT CAST(extract(year FROM timestamp) AS INTEGER) AS year,
  CAST(extract(month FROM timestamp) AS INTEGER) AS month, content_type,
  CAST(sum(ms_played) AS BIGINT) AS ms_played, count(*) AS plays,
  {r("avg(coalesce(f.valence, m.v))", "valence")}
FROM {_RAW}
GROUP BY ALL""",
    ),
)
def pipeline_enrich(spark, sf):
    """The enrichment stage as the pipeline runs it: materialised steps, files at the end."""
    out = _folder(spark)
    pipeline.enrich(plays_from_orders(spark, sf), out, audio_features(spark, sf))
    monthly = load_enriched(spark, out).rollups["monthly_stats"]
    columns = ["year", "month", "content_type", "ms_played", "plays", "valence"]
    return rounded(monthly.select(*columns), 6, "valence")


@check("pipeline_analyze", f"SELECT * REPLACE (CAST(ord AS BIGINT) AS ord) FROM ({ORACLES['insights']})")
def pipeline_analyze(spark, sf):
    """The analysis stage: all results are written, and the sentences that sum them up."""
    out = _folder(spark)
    pipeline.analyze(materialize(rows(spark, sf, "events", sessions=True), "enriched"), out)
    return spark.read.json(f"{out}/{INSIGHTS}")


@check(
    "pipeline_run",
    f"""WITH {SOURCE_SQL}
SELECT CAST(timestamp AS DATE) AS date, content_type, coalesce(CAST(sum(ms_played) AS BIGINT), 0) AS ms_played,
  count(*) AS plays, count(*) FILTER (skipped) AS skips
FROM parsed WHERE timestamp IS NOT NULL GROUP BY ALL""",
)
def pipeline_run(spark, sf):
    """All stages in turn, from files to results; the daily table of the last one's input."""
    out = _folder(spark)
    folders = [f"{out}/{name}" for name in ("processed", "enriched", "results")]
    pipeline.run(spark, whole_files(spark, sf), *folders)
    assert spark.read.json(f"{folders[2]}/{INSIGHTS}").count() == 8
    daily = load_enriched(spark, folders[1]).rollups["daily_stats"]
    return daily.select("date", "content_type", "ms_played", "plays", "skips")
