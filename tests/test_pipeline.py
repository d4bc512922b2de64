"""Whole pipeline from export files to results on disk, sinks, clustering."""

import pytest
from pyspark.sql import functions as F

from checks.adapters import audio_features, plays_from_events
from checks.base import rows as base_rows
from playtrail.operators.rollup import class_cube, name_cube, play_cube
from playtrail.params import PlayParams
from playtrail.plans import clustering, efficiency, explore, pipeline, platform, rollups, texts
from playtrail.plans import session_behavior as behavior
from playtrail.plans.enrich import enrich
from playtrail.plans.insights import generate_insights
from playtrail.session import materialize, remove_folder, work_folder
from playtrail.sinks import writers
from playtrail.sources.history import discover_files
from playtrail.sources.tables import load_enriched


@pytest.fixture(scope="module")
def raw(spark, sf, tmp_path_factory):
    """Export files on disk, from the events table."""
    from checks.ingest_checks import export_files

    folder = tmp_path_factory.mktemp("raw")
    for row in export_files(spark, sf).collect():
        (folder / row.file_source).write_text(row.text)
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, sf, raw, tmp_path_factory):
    out = {n: str(tmp_path_factory.mktemp(n)) for n in ("processed", "enriched", "results")}
    features = audio_features(spark, sf).withColumn(
        "track_id", F.concat(F.lit("uri:"), F.split("track_id", ":")[1])
    )
    pipeline.run(spark, raw, features=features, **out)
    return out


def test_stages_leave_their_files(spark, folders):
    data = load_enriched(spark, folders["enriched"])
    parsed = spark.read.parquet(f"{folders['processed']}/{writers.PARSED}")
    assert data.plays.count() == parsed.count() > 0
    assert set(data.rollups) == {
        "daily_stats", "weekly_stats", "monthly_stats", "artist_stats", "time_stats",
    }
    assert data.summary.first().dataset_overview.total_records == parsed.count()


def test_parse_statistics_account_for_every_file_and_row(spark, raw, folders):
    out = folders["processed"]
    stats = spark.read.json(f"{out}/parsing_statistics.json").first()
    parsed = spark.read.parquet(f"{out}/{writers.PARSED}")
    assert stats.total_records == parsed.count()
    kinds = ("music", "podcast", "audiobook", "video")
    assert sum(stats[f"{k}_records"] for k in kinds) == stats.total_records
    assert stats.total_files == discover_files(spark, raw).count()
    assert stats.errors == spark.read.parquet(f"{out}/rejects.parquet").count() > 0


def test_rollups_add_up_to_the_plays(spark, folders):
    data = load_enriched(spark, folders["enriched"])
    timed = data.plays.filter("date is not null").agg(F.sum("ms_played")).first()[0]
    for name in ("daily_stats", "weekly_stats", "monthly_stats"):
        assert data.rollups[name].agg(F.sum("ms_played")).first()[0] == timed
    everything = data.plays.agg(F.sum("ms_played")).first()[0]
    assert data.rollups["artist_stats"].agg(F.sum("ms_played")).first()[0] == everything


def test_written_rollups_equal_direct_ones(spark, folders):
    data = load_enriched(spark, folders["enriched"])
    direct = {name: getattr(rollups, name)(data.plays) for name in data.rollups}
    for name, table in data.rollups.items():
        exact = [c for c, t in table.dtypes if t != "double"]
        left, right = table.select(*exact), direct[name].select(*exact)
        assert left.exceptAll(right).count() == right.exceptAll(left).count() == 0, name


def test_results_are_machine_readable(spark, folders):
    out = folders["results"]
    daily = spark.read.json(f"{out}/temporal_patterns_results.json/daily_stats")
    assert "listening_hours" in daily.columns and daily.count() > 0
    insights = spark.read.json(f"{out}/{writers.INSIGHTS}").collect()
    assert len(insights) == 8
    assert {r.category for r in insights} == {
        "temporal_insights", "session_insights", "platform_insights", "efficiency_insights",
    }


def test_single_stages_and_errors(spark, raw, tmp_path):
    out = {n: str(tmp_path / n) for n in ("processed", "enriched", "results")}
    pipeline.run(spark, raw, stages=("parse",), **out)
    pipeline.run(spark, raw, stages=("enrich",), **out)
    assert load_enriched(spark, out["enriched"]).plays.first().mood == "Happy"
    with pytest.raises(ValueError):
        pipeline.run(spark, raw, stages=("paint",), **out)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pipeline.run(spark, raw, str(tmp_path / "none"), "x", "y", stages=("enrich",))


def test_empty_input_stops_after_parsing(spark, tmp_path):
    out = {n: str(tmp_path / n) for n in ("processed", "enriched", "results")}
    with pytest.warns(UserWarning):
        pipeline.run(spark, str(tmp_path / "nothing"), **out)
    assert load_enriched(spark, out["enriched"]).plays is None


def test_order_of_join_and_sessions_does_not_matter_for_unique_features(spark, sf):
    plays, features = plays_from_events(spark, sf), audio_features(spark, sf)
    assert features.count() == features.select("track_id").distinct().count()
    one = enrich(plays, features, unique_features=True)
    two = enrich(plays, features).select(*one.columns)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_no_analysis_no_insight(spark):
    assert generate_insights({}, spark).count() == 0


def test_csv_and_report(spark, sf, tmp_path):
    plays = base_rows(spark, sf, "events")
    kept = explore.filter_plays(plays, content_type="video")
    writers.write_csv(kept, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert (back.count(), set(back.columns)) == (kept.count(), set(kept.columns))
    report = explore.summary_report(plays)
    writers.write_report(report, str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines == [r.line for r in report.orderBy("section_ord", "ord").collect()]
    assert lines[:4] == [*texts.TITLE, "", "BASIC STATISTICS:"] and lines.count("") == 4


def test_filters(spark, sf):
    plays = base_rows(spark, sf, "orders")
    assert explore.filter_plays(plays).count() == plays.count()
    day = plays.agg(F.min("date")).first()[0]
    assert explore.filter_plays(plays, day, day).count() == plays.filter(F.col("date") == day).count()


def test_work_folder_comes_from_the_session(spark):
    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert work_folder(spark) == work_folder(spark)
    kept = materialize(spark.range(3), "three")
    assert kept.count() == 3


def test_intermediate_folder_is_removed(spark, tmp_path):
    (tmp_path / "x" / "part").mkdir(parents=True)
    remove_folder(spark, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    remove_folder(spark, str(tmp_path / "never-there"))


# --- clusters ---------------------------------------------------------------------


def test_tables_next_to_the_plays_in_an_odd_folder(spark, sf, tmp_path):
    folder = str(tmp_path / "out+v1 (a)")
    plays = base_rows(spark, sf, "events")
    writers.write_enriched(plays, folder)
    writers.write_tables({"daily_stats": rollups.daily_stats(plays)}, folder)
    assert list(load_enriched(spark, folder).rollups) == ["daily_stats"]


def test_no_analyses_give_no_insights(spark):
    assert generate_insights({}).count() == 0


def test_broken_promise_of_unique_features(spark, sf):
    features = audio_features(spark, sf)
    with pytest.raises(ValueError):
        enrich(plays_from_events(spark, sf), features.union(features), unique_features=True)


def test_clusters(spark, sf):
    sessions = materialize(behavior.session_stats(base_rows(spark, sf, "events")), "s")
    clustered = clustering.cluster_sessions(sessions).cache()
    assert clustered.count() == sessions.count()
    assert clustered.select("content_type", "session_id").distinct().count() == sessions.count()
    named = dict(clustered.select("cluster", "cluster_type").distinct().collect())
    assert named == dict(enumerate(clustering.CLUSTER_LABELS))
    means = {r.cluster_type: r for r in clustering.cluster_analysis(clustered).collect()}
    longest = max(means.values(), key=lambda r: r.session_duration_minutes)
    assert longest.cluster_type == "Long Sessions"
    total = clustering.cluster_distribution(clustered).agg(F.sum("n")).first()[0]
    assert total == sessions.count()


def test_clusters_do_not_depend_on_input_partitions(spark, sf):
    sessions = materialize(behavior.session_stats(base_rows(spark, sf, "events")), "s")
    sizes = [
        sorted(clustering.cluster_distribution(clustering.cluster_sessions(p)).collect())
        for p in (sessions.repartition(1), sessions.repartition(7))
    ]
    assert sizes[0] == sizes[1]
    centres = [clustering.find_centres(sessions.repartition(n)) for n in (1, 3, 8)]
    assert centres[0] == centres[1] == centres[2] and len(centres[0].values) == 4


@pytest.mark.parametrize("count", [0, 1, 3, 4])
def test_few_sessions_all_get_a_cluster(spark, sf, count):
    sessions = behavior.session_stats(base_rows(spark, sf, "events")).limit(count).cache()
    clustered = clustering.cluster_sessions(sessions)
    assert clustered.count() == count
    assert clustered.filter("cluster IS NULL OR cluster_type IS NULL").count() == 0


def test_multi_user_sessions_are_counted_per_user(spark, sf):
    params = PlayParams(keys=("user_id", "content_type"), session_timeout_ms=86_400_000)
    enriched = enrich(plays_from_events(spark, sf), params=params, gaps=False)
    sessions = behavior.session_stats(enriched, params)
    key = params.session_key
    counted = rollups.platform_stats(enriched, session_key=key)
    direct = enriched.groupBy("platform_category", "content_type").agg(
        F.countDistinct("user_id", "session_id").alias("n")
    )
    joined = counted.join(direct, ["platform_category", "content_type"])
    assert joined.filter("total_sessions <> n").count() == 0
    assert sessions.count() == enriched.select(*params.keys, "session_id").distinct().count()
    monthly = rollups.monthly_stats(enriched, session_key=key)
    cubed = rollups.monthly_stats(
        name_cube(enriched), rollups.session_cube(enriched, key), session_key=key
    )
    columns = ["year", "month", "content_type", "plays", "total_sessions"]
    assert monthly.select(columns).exceptAll(cubed.select(columns)).count() == 0
    assert play_cube(enriched).agg(F.sum("plays")).first()[0] == enriched.count()


def test_class_cube_stands_for_the_play_cube(spark, sf):
    plays = base_rows(spark, sf, "events")
    odd = ("date", "year", "hour", "time_of_day", "content_type", "platform_category", "mood", "ms_played", "valence")
    nulls = plays.limit(40).withColumns({c: F.when(F.col("play_id") % 3 > 0, F.col(c)) for c in odd})
    cube = materialize(play_cube(plays.unionByName(nulls).unionByName(plays.limit(9))), "odd_cube")
    classes = class_cube(cube)
    assert classes.count() < cube.count()

    def rows(df):
        return sorted((str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect()))

    def distribution(column):
        return lambda df: rollups.value_counts(df, column)

    for result in (
        rollups.time_stats,
        rollups.audio_features_summary,
        platform.platform_evolution,
        efficiency.time_efficiency,
        efficiency.feature_efficiency,
        efficiency.overall_efficiency,
        *map(distribution, ("content_type", "mood", "platform_category")),
    ):
        assert rows(result(classes)) == rows(result(cube))


def test_only_results_by_day_read_the_play_cube(spark, sf, tmp_path, monkeypatch):
    readers = []

    def noted(f):
        def call(df, *args):
            readers.append(f"{f.__name__} {'play_cube' in ''.join(df.inputFiles())}")
            return f(df, *args)

        return call

    for name in ("daily_stats", "time_stats", "value_counts", "audio_features_summary", "listening_behavior"):
        monkeypatch.setattr(rollups, name, noted(getattr(rollups, name)))
    pipeline.enrich(plays_from_events(spark, sf), str(tmp_path), audio_features(spark, sf))
    assert [r for r in readers if r.endswith("True")] == ["daily_stats True"]
    assert len(readers) == 7
