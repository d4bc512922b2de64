"""Medians, cleaning, joins, grids, ranking, histograms, cubes."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from playtrail.functions.nulls import ratio
from playtrail.operators import cleaning, joins
from playtrail.operators.grid import densify
from playtrail.operators.histogram import histogram
from playtrail.operators.medians import column_medians, exact_median
from playtrail.operators.ranking import peak_per_group, top_rows


@pytest.mark.parametrize("accuracy", [20, 200, 100_000])
@pytest.mark.parametrize("kind", ["uniform", "ties", "outlier"])
def test_exact_median_by_group(spark, accuracy, kind):
    """A coarse sketch must still give the exact answer."""
    rng = random.Random(7)
    draw = {
        "uniform": lambda: rng.random(),
        "ties": lambda: float(rng.randrange(5)),
        "outlier": lambda: rng.choice([rng.random(), 1e15]),
    }[kind]
    rows = [(f"g{i % 7}", draw()) for i in range(20_000)]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("nulls", None), ("nan", float("nan"))]
    rows += [("four", 1.0), ("four", 2.0), ("four", 4.0), ("four", 10.0)]
    df = spark.createDataFrame(rows, "mood string, x double").repartition(16)
    got = {r.mood: r.median for r in exact_median(df, ["mood"], "x", accuracy=accuracy).collect()}
    values = {}
    for k, x in rows:
        if x is not None and x == x:
            values.setdefault(k, []).append(x)
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_median_keys_must_be_closed_domains(spark):
    with pytest.raises(ValueError):
        exact_median(spark.range(3), ["id"], "id")


def test_exact_median_over_everything(spark):
    df = spark.range(1001).select((F.col("id") * 2).alias("x"))
    assert exact_median(df, [], "x", "m").collect() == [(1000.0,)]


def test_column_medians_leave_out_all_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert column_medians(df, ["a", "b"]).collect() == [("a", 1.5)]


def test_median_fill_counts_nan_as_missing_and_keeps_all_null(spark):
    rows = [(1.0, None), (float("nan"), None), (3.0, None), (None, None)]
    df = spark.createDataFrame(rows, "energy double, tempo double")
    filled = cleaning.fill_medians(df).collect()
    assert sorted(r.energy for r in filled) == [1.0, 2.0, 2.0, 3.0]
    assert {r.tempo for r in filled} == {None}


def test_constants(spark):
    schema = "track_name string, artist_name string, album_name string, skipped boolean, platform string, key int"
    row = cleaning.fill_constants(spark.createDataFrame([(None,) * 6], schema)).first()
    assert tuple(row) == ("Unknown Track", "Unknown Artist", "Unknown Album", False, "Unknown", -1)


def plays(spark):
    rows = [(1, "a", 5), (2, "b", 6), (3, None, 7)]
    return spark.createDataFrame(rows, "play_id bigint, track_uri string, tempo int")


def test_join_keeps_plays_fans_out_and_renames(spark):
    features = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), (None, 9.0)], "track_id string, tempo double"
    )
    out = joins.join_audio_features(plays(spark), features)
    assert out.columns == ["play_id", "track_uri", "tempo", "track_id", "tempo_audio"]
    got = sorted((r.play_id, r.tempo_audio) for r in out.collect() if r.tempo_audio)
    assert got == [(1, 1.0), (1, 2.0)]
    assert joins.feature_coverage(out).first().asDict() == {"records": 4, "with_features": 2}


def test_join_without_key_returns_plays(spark):
    other = spark.createDataFrame([(1,)], "x int")
    assert joins.join_audio_features(plays(spark), other).columns == plays(spark).columns


def test_grid_reports_every_level(spark):
    cells = spark.createDataFrame(
        [("Winter", "music", 5, 1.5), ("Fall", "video", 2, None)],
        "season string, content_type string, plays bigint, valence double",
    )
    dense = densify(cells, "season", ["content_type"], ["plays"]).collect()
    assert len(dense) == 8
    values = {(r.season, r.content_type): (r.plays, r.valence) for r in dense}
    assert values["Winter", "music"] == (5, 1.5)
    assert values["Fall", "video"] == (2, None)
    assert values["Summer", "video"] == (0, None)


def test_grid_of_nothing(spark):
    cells = spark.createDataFrame([], "season string, plays bigint")
    dense = densify(cells, "season", [], ["plays"]).collect()
    assert [(r.season, r.plays) for r in dense] == [
        ("Winter", 0), ("Spring", 0), ("Summer", 0), ("Fall", 0),
    ]


def test_ties_resolve_by_key(spark):
    df = spark.createDataFrame([("b", 1, 2.0), ("a", 1, 2.0), ("c", 2, None)], "k string, g int, h double")
    assert top_rows(df, "h", 1, ["k"]).first().k == "a"
    assert [r.k for r in top_rows(df, "h", 3, ["k"]).collect()] == ["a", "b", "c"]
    assert sorted(r.k for r in peak_per_group(df, ["g"], "h", ["k"]).collect()) == ["a", "c"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(31)] + [(None,)], "x double")
    got = {r.bin: r.n for r in histogram(df, "x").collect()}
    assert got == {**{b: 1 for b in range(1, 30)}, 30: 2}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(4.0, 3), (4.0, 2)], "x double, w bigint")
    assert [(r.bin, r.n) for r in histogram(df, "x").collect()] == [(1, 2)]
    assert [(r.bin, r.n) for r in histogram(df, "x", weight="w").collect()] == [(1, 5)]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 2)], "a int, b int")
    assert [r.x for r in df.select(ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [None, 0.5]


def test_medians_of_odd_columns(spark):
    nan, rows = float("nan"), []
    for k in range(301):
        rows.append(("music", float(k % 7), 0.0 if k % 2 else -0.0, None, nan if k % 3 else float(k)))
        rows.append(("video", None if k % 5 else 3.0, float(k % 2), None, float(-k)))
        rows.append((None, 1e6, 1e6, 1e6, 1e6))
    df = spark.createDataFrame(rows + rows[:9], "content_type string, a double, b double, c double, d double")

    def expected(kinds):
        for j, name in enumerate("abcd", 1):
            values = [r[j] for r in rows + rows[:9] if r[0] in kinds and r[j] is not None and r[j] == r[j]]
            if values:
                yield name, statistics.median(values)

    everything = column_medians(df, ["a", "b", "c", "d"]).collect()
    assert sorted(map(tuple, everything)) == sorted(expected({"music", "video", None}))
    by_kind = column_medians(df, ["a", "b", "c", "d"], keys=["content_type"]).collect()
    want = [(kind, *pair) for kind in ("music", "video") for pair in expected({kind})]
    assert sorted(map(tuple, by_kind)) == sorted(want)
    assert column_medians(df.limit(0), ["a", "b"]).collect() == []
