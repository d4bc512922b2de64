"""What the physical plans must and must not contain."""

import pytest

from checks import QUERIES
from checks.adapters import plays_from_events
from checks.base import rows as base_rows
from playtrail.operators import sessions
from playtrail.plans import explore, rollups
from playtrail.plans import session_behavior as behavior
from playtrail.sinks import writers
from playtrail.sources.tables import load_enriched


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that run jobs while being built.
EAGER = {n for n in QUERIES if n.startswith(("sink_", "cluster_", "pipeline_", "parsed_"))}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairwise_join_and_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in text


def test_session_table_scans_plays_once_and_never_joins_them(spark, sf):
    text = plan(behavior.session_stats(base_rows(spark, sf, "events")))
    assert text.count("events.parquet") == 1
    bare = plan(sessions.session_slots(plays_from_events(spark, sf)))
    assert "Join" not in bare


def test_rollup_combines_before_its_one_shuffle(spark, sf):
    text = plan(rollups.daily_stats(base_rows(spark, sf, "events")))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum(ms_played" in text


def test_rollup_reads_only_its_columns(spark, sf):
    text = plan(explore.hours_by_content_type(base_rows(spark, sf, "orders")))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "o_orderdate" not in schema and "o_orderpriority" not in schema


def test_filters_reach_the_stored_table(spark, sf, tmp_path):
    writers.write_enriched(base_rows(spark, sf, "orders"), str(tmp_path))
    stored = load_enriched(spark, str(tmp_path)).plays
    kept = explore.filter_plays(stored, "1996-02-01", "1996-12-31", "music", "Mobile")
    text = plan(explore.kpis(kept))
    assert "(year" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    pushed = text.split("PushedFilters: [")[1]
    for column in ("date", "content_type", "platform_category"):
        assert column in pushed
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "valence" not in read and "timestamp" not in read


def test_small_features_are_broadcast_by_their_size_only(spark, sf):
    query = QUERIES["feature_join"]
    assert "BroadcastHashJoin" in plan(query(spark, sf))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" in plan(query(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_read(df) -> int:
    """Rows that the scan of a one-table query gave on, after it skipped row groups and pages."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        for inner in ("executedPlan", "plan"):
            if name in ("AdaptiveSparkPlan", "ShuffleQueryStage", "ResultQueryStage"):
                try:
                    walk(getattr(node, inner)())
                    break
                except Exception:
                    continue

    walk(plan)
    (only,) = found
    return only


def test_stored_plays_are_skipped_by_day_and_artist(spark, sf, tmp_path):
    out = str(tmp_path)
    settings = {"parquet.block.size": str(1 << 15), "parquet.page.row.count.limit": "100"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: hadoop.get(k) for k in settings}
    for k, v in settings.items():
        hadoop.set(k, v)
    try:
        plays = base_rows(spark, "/root/testdata/sf0.01", "orders")
        writers.write_enriched(plays, out)
    finally:
        for k, v in before.items():
            hadoop.set(k, v) if v else hadoop.unset(k)
    stored = load_enriched(spark, out).plays
    total = stored.count()
    day = stored.where("date = DATE '1996-03-05'").select("play_id", "ms_played")
    assert day.count() > 0 and rows_read(day) < total / 20
    least = stored.agg({"artist_name": "min"}).first()[0]
    artist = stored.where(f"artist_name = '{least}x'").select("play_id")
    assert rows_read(artist) == 0


def test_keyed_medians_move_no_play_by_its_key(spark, sf):
    from playtrail.operators.medians import exact_median

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plays = base_rows(spark, sf, "events").select("content_type", "listening_efficiency")
        text = plan(exact_median(plays, ["content_type"], "listening_efficiency"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning(content_type" in line:
            # What is moved by the key was aggregated since the last exchange.
            below = lines[k + 1 :]
            stop = next((j for j, x in enumerate(below) if "Exchange" in x or "Scan" in x), len(below))
            assert any("Aggregate" in x for x in below[:stop]), line


def test_medians_read_their_rows_twice(spark, sf, tmp_path):
    from playtrail.operators.medians import column_medians

    spark.range(100).selectExpr("'music' AS content_type", "id * 1D AS a", "id * 2D AS b").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for keys in ([], ["content_type"]):
        medians = column_medians(table, ["a", "b"], keys=keys)
        assert sorted(r[-2:] for r in medians.collect()) == [("a", 49.5), ("b", 99.0)]
        text = medians._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation ") == 2, text


def test_distinct_counts_expand_combinations_not_plays(spark, sf):
    for table in (rollups.weekly_stats, rollups.monthly_stats, rollups.dataset_overview):
        lines = plan(table(base_rows(spark, sf, "orders", sessions=True))).split("\n")
        for k, line in enumerate(lines):
            if "Expand" in line:
                assert "HashAggregate" in lines[k + 1] or "Project" in lines[k + 1], lines[k + 1]
