"""Sessions against brute force, and exact gap edges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from playtrail.operators import sessions
from playtrail.params import PlayParams
from playtrail.plans.session_behavior import session_stats

SCHEMA = "play_id bigint, us bigint, content_type string, ms_played bigint, track_name string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select(
        "play_id",
        F.timestamp_micros("us").alias("timestamp"),
        "content_type",
        "ms_played",
        "track_name",
    )


def brute_force(rows, timeout_us):
    """play_id -> (gap_us, new, session, total ms, tracks, start, end)"""
    by_key = defaultdict(list)
    for row in rows:
        if row[1] is not None:
            by_key[row[2]].append(row)
    out = {}
    for plays in by_key.values():
        plays.sort(key=lambda x: (x[1], x[0]))
        number, previous, groups = 0, None, defaultdict(list)
        for play in plays:
            gap = None if previous is None else play[1] - previous
            new = gap is None or gap > timeout_us
            number += new
            groups[number].append(play)
            out[play[0]] = [gap, new, number]
            previous = play[1]
        for number, members in groups.items():
            total = sum(m[3] or 0 for m in members)
            tracks = sum(m[4] is not None for m in members)
            for m in members:
                out[m[0]] += [total, tracks, members[0][1], members[-1][1]]
    return {k: tuple(v) for k, v in out.items()}


def spark_result(plays, params):
    both = sessions.add_session_features(plays, params)
    rows = both.select(
        "play_id",
        F.round(F.col("time_since_last") * 1000).cast("bigint").alias("gap"),
        "new_session",
        "session_id",
        "session_duration",
        "tracks_in_session",
        F.unix_micros("session_start").alias("start"),
        F.unix_micros("session_end").alias("end"),
    ).collect()
    return {r.play_id: tuple(r)[1:] for r in rows if r.session_id is not None}


@pytest.mark.parametrize("seed,span", [(1, 10**8), (2, 10**10), (3, 10**12), (4, 3)])
@pytest.mark.parametrize("timeout_ms", [1, 1_500, 1_800_000])
def test_against_brute_force(spark, seed, span, timeout_ms):
    rng = random.Random(seed)
    start = rng.choice([0, -(span // 2), 1_700_000_000_000_000])
    rows = [
        (
            i,
            None if rng.random() < 0.02 else start + rng.randrange(span),
            rng.choice(["music", "music", "video"]),
            rng.choice([None, rng.randrange(10**6)]),
            rng.choice([None, "t"]),
        )
        for i in range(400)
    ]
    params = PlayParams(session_timeout_ms=timeout_ms)
    assert spark_result(frame(spark, rows), params) == brute_force(rows, timeout_ms * 1000)


def test_gap_equal_to_timeout_stays_and_one_more_microsecond_breaks(spark):
    t, limit = 1_700_000_000_123_456, 1_800_000_000
    rows = [
        (1, t, "music", 1, "a"),
        (2, t + limit, "music", 1, "a"),
        (3, t + 2 * limit + 1, "music", 1, "a"),
    ]
    got = spark_result(frame(spark, rows), PlayParams())
    assert [got[i][2] for i in (1, 2, 3)] == [1, 1, 2]
    assert [got[i][1] for i in (1, 2, 3)] == [True, False, True]


def test_many_plays_at_one_instant_are_one_session(spark):
    rows = [(i, 5_000_000, "music", 10, "a") for i in range(1000)]
    got = spark_result(frame(spark, rows), PlayParams())
    assert {v[2] for v in got.values()} == {1}
    assert sum(v[1] for v in got.values()) == 1
    assert sorted(v[0] for v in got.values() if v[0] is not None) == [0] * 999


def test_plays_without_time_have_no_session_and_are_kept(spark):
    rows = [(1, None, "music", 10, "a"), (2, 1, "music", 10, "a")]
    placed = sessions.add_session_features(frame(spark, rows)).orderBy("play_id").collect()
    assert [r.session_id for r in placed] == [None, 1]
    assert len(placed) == 2


def test_repeated_ids_and_null_keys_keep_every_play(spark):
    rows = [(7, 10, "music", 1, "a"), (7, 10, "music", 1, "a"), (7, 20, "music", 1, "a")]
    rows += [(8, 10, None, 1, "a"), (None, 5, None, 1, "a"), (None, 5, None, 1, "a")]
    rows += [(9, None, None, 1, "a")]
    placed = sessions.add_session_features(frame(spark, rows)).collect()
    assert len(placed) == len(rows)
    assert sum(r.new_session for r in placed if r.session_id is not None) == 2
    music = sorted(r.time_since_last for r in placed if r.content_type and not r.new_session)
    assert music == [0.0, 0.01]
    assert sorted(r.session_id or 0 for r in placed) == [0, 1, 1, 1, 1, 1, 1]


def test_session_table_partitions_the_plays(spark, sf):
    from checks.base import rows as base_rows

    plays = base_rows(spark, sf, "events")
    table = session_stats(plays).agg(F.sum("n_rows"), F.sum("session_duration")).first()
    direct = plays.agg(F.count("*"), F.sum("ms_played")).first()
    assert tuple(table) == tuple(direct)
