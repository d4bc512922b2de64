"""The batch pipeline: parse, enrich, analyse; whole or in stages.

The plays are read a fixed number of times whatever the number of results: once for the
session slots, once to write the enriched table, once for each of four intermediate
rollups (plays, names, session days, sessions), and for the exact medians.  Results that ask
for years and classes only come from a fifth one, made of the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playtrail.operators.cleaning import fill_missing
from playtrail.operators.joins import join_audio_features
from playtrail.operators.rollup import class_cube, name_cube, play_cube
from playtrail.operators.sessions import session_index
from playtrail.params import DEFAULTS, PlayParams
from playtrail.plans import clustering, efficiency, insights, platform, rollups, temporal
from playtrail.plans import session_behavior as behavior
from playtrail.plans.enrich import create_derived_metrics
from playtrail.session import materialize, prepare
from playtrail.sinks import writers
from playtrail.sinks.layout import REJECTS
from playtrail.sinks.versions import current, new_version
from playtrail.sources.history import (
    discover_files,
    plays_of,
    read_parsed,
    read_parsed_lines,
    rejects_of,
)
from playtrail.sources.tables import read_plays

STAGES = ("parse", "enrich", "analyze")


def parse(
    spark: SparkSession,
    raw: str,
    out: str,
    bad_ts_value: Column | None = None,
    report: bool = True,
    lines: bool = False,
) -> DataFrame:
    """Exports -> parsed plays table, rejects and parse statistics.

    The exports are parsed once: every element is stored with the reason why it is no play,
    if it is none; plays and rejects are filters of that table, and the statistics are
    observed while it is written.  ``lines``: files hold one object per line.
    ``report=False`` leaves out rejects and statistics.
    """
    prepare(spark)
    observed = Observation("parsed elements")
    files = discover_files(spark, raw, "*.json*" if lines else "*.json")
    elements = read_parsed_lines(spark, raw, bad_ts_value) if lines else read_parsed(spark, raw, bad_ts_value, files=files)
    elements = elements.observe(observed, *rollups.parse_counts())
    stored = materialize(elements, "parsed_elements")
    plays = read_plays(spark, writers.write_plays(plays_of(stored), out))
    if report:
        writers.write_table(rejects_of(stored), out, REJECTS)
        counts = spark.createDataFrame([observed.get], rollups.PARSE_COUNTS)
        total = files.agg(F.count(F.lit(1))).scalar()
        writers.write_statistics(counts.withColumn("total_files", total), out)
    return plays


@dataclass(frozen=True)
class Parts:
    """Intermediate rollups all results are computed from, each written once."""

    cube: DataFrame
    classes: DataFrame
    names: DataFrame
    session_days: DataFrame
    sessions: DataFrame


def intermediate_rollups(enriched: DataFrame, params: PlayParams = DEFAULTS) -> Parts:
    cube = materialize(play_cube(enriched), "play_cube")
    return Parts(
        cube,
        materialize(class_cube(cube), "class_cube"),
        materialize(name_cube(enriched), "name_cube"),
        materialize(rollups.session_cube(enriched, params.session_key), "session_days"),
        materialize(behavior.session_stats(enriched, params), "sessions"),
    )


def enrich(
    plays: DataFrame,
    out: str,
    features: DataFrame | None = None,
    params: PlayParams = DEFAULTS,
) -> tuple[DataFrame, Parts]:
    """Parsed plays -> enriched table, five rollups and the summary, all written."""
    spark = prepare(plays.sparkSession)
    if features is not None:
        # Joined once, read many times.
        plays = materialize(join_audio_features(plays, features), "plays_with_features")
    filled = fill_missing(plays, params)
    index = materialize(session_index(filled, params), "session_index")
    derived = create_derived_metrics(filled, params, index, tempos=plays)
    enriched = spark.read.parquet(writers.write_enriched(derived, out))

    parts = intermediate_rollups(enriched, params)
    writers.write_tables(
        {
            "daily_stats": rollups.daily_stats(parts.cube),
            "weekly_stats": rollups.weekly_stats(parts.names),
            "monthly_stats": rollups.monthly_stats(
                parts.names, parts.session_days, params.session_key
            ),
            "artist_stats": rollups.artist_stats(parts.names),
            "time_stats": rollups.time_stats(parts.classes),
        },
        out,
    )
    writers.write_summary(rollups.summary_document(enriched, parts.sessions, parts.classes), out)
    return enriched, parts


def analyze(
    enriched: DataFrame, out: str, params: PlayParams = DEFAULTS, parts: Parts | None = None
) -> tuple[dict[str, dict[str, DataFrame]], DataFrame]:
    """Enriched table -> analysis results and insights, all written.

    ``parts`` are reused when the enrichment stage has just made them.
    """
    prepare(enriched.sparkSession)
    if parts is None:
        parts = intermediate_rollups(enriched, params)
    clustered = materialize(clustering.cluster_sessions(parts.sessions, params), "clustered")
    results = {
        "temporal_patterns": temporal.analyze_temporal_patterns(
            parts.cube, parts.classes, parts.names, parts.session_days, materialize, params
        ),
        "session_behavior": {
            "session_stats": parts.sessions,
            "session_patterns": behavior.session_patterns(parts.sessions, params),
            "binge_sessions": behavior.binge_sessions(parts.sessions, params),
            "session_totals": behavior.session_totals(parts.sessions),
            "cluster_analysis": clustering.cluster_analysis(clustered),
            "cluster_distribution": clustering.cluster_distribution(clustered),
        },
        "platform_usage": platform.analyze_platform_usage(
            parts.classes, parts.session_days, materialize, params
        ),
        "listening_efficiency": efficiency.analyze_listening_efficiency(
            parts.classes, parts.names, enriched, materialize, params
        ),
    }
    writers.write_results(results, out)
    sentences = insights.generate_insights(results)
    writers.write_insights(sentences, out)
    return results, sentences


@contextmanager
def _output(spark: SparkSession, root: str, versioned: bool) -> Iterator[str]:
    if versioned:
        with new_version(spark, root) as folder:
            yield folder
    else:
        yield root


def run(
    spark: SparkSession,
    raw: str,
    processed: str,
    enriched: str,
    results: str,
    features: DataFrame | None = None,
    params: PlayParams = DEFAULTS,
    stages: tuple[str, ...] = STAGES,
    versioned: bool = False,
) -> None:
    """Run the given stages; a later stage alone starts from the earlier one's files.

    Errors are raised, never swallowed.  Stops after parsing if there are no plays.
    ``versioned``: each stage writes a new version of its folder, which later stages and
    readers see when it is complete, so a stage that was killed is just run again.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    if "parse" in stages:
        with _output(spark, processed, versioned) as out:
            parse(spark, raw, out)
    parts = None
    if "enrich" in stages:
        plays = read_plays(spark, f"{current(spark, processed)}/{writers.PARSED}")
        if plays.isEmpty():
            return
        with _output(spark, enriched, versioned) as out:
            _, parts = enrich(plays, out, features, params)
    if "analyze" in stages:
        stored = spark.read.parquet(f"{current(spark, enriched)}/{writers.ENRICHED}")
        with _output(spark, results, versioned) as out:
            analyze(stored, out, params, parts)
