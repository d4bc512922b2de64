"""Large JSON arrays, read in many ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from checks.ingest_checks import export_folder
from playtrail.sources import arrays, history


def cut(text: bytes, ranges: list[bytes]) -> dict[int, bytes]:
    """Elements of a text given as ranges, each entered with what the summaries before say."""
    summaries = []
    for part in ranges:
        s = arrays.Summary()
        s.feed(part)
        summaries.append(s)
    inside = depth = before = 0
    seen = False
    array = next(s.array for s in summaries if s.array is not None)
    found: dict[int, bytes] = {}
    for k, (part, s) in enumerate(zip(ranges, summaries)):
        cutter = arrays.Cutter(0 if k == 0 else 1, array, inside, depth, before, seen and depth == 0)
        for pos, whole, piece in [*cutter.feed(part), *cutter.end(k == len(ranges) - 1)]:
            assert pos is not None, piece
            assert not (whole and pos in found)
            found[pos] = found.get(pos, b"") + piece
        before += s.commas[inside].get(1 - depth, 0)
        depth += s.depth[inside]
        inside ^= s.turns
        seen |= s.array is not None
    assert (inside, depth) == (0, 0)
    return {p: t for p, t in found.items() if p or t.strip()}


def value(rng, depth=0):
    kinds = ["text", "number", "null", "true"] + (["array", "object"] if depth < 4 else [])
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice('ab"\\{}[],: \n\té🎧') for _ in range(rng.randint(0, 12)))
    if kind == "array":
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == "object":
        return {value_text(rng): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return {"number": rng.random(), "null": None, "true": True}[kind]


def value_text(rng):
    return "".join(rng.choice('k"\\}{,') for _ in range(rng.randint(0, 5)))


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_gives_the_elements(seed):
    rng = random.Random(seed)
    items = [value(rng) for _ in range(rng.randint(0, 12))]
    text = json.dumps(items, ensure_ascii=seed % 2 == 0, indent=[None, 1][seed % 3 == 0]).encode()
    places = [0, *(i + 1 for i, c in enumerate(text) if c == ord("}") and rng.random() < 0.5), len(text)]
    ranges = [text[a:b] for a, b in zip(places, places[1:]) if a < b]
    found = cut(text, ranges)
    assert [json.loads(found[k]) for k in range(len(found))] == items


@pytest.fixture
def small_ranges(spark):
    """Ranges of 4 KB instead of 128 MB."""
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exports(folder):
    rng = random.Random(1)

    def play(k):
        return {
            "ts": 1704067200 + k,
            "ms_played": k,
            "master_metadata_track_name": "".join(rng.choice('ab"\\{}[],: é🎧') for _ in range(rng.randint(0, 60))),
            "extra": value(rng),
        }

    long = [play(k) for k in range(2000)] + [7, None, "a } text, [", [1, {"x": "}"}], {}]
    rng.shuffle(long)
    long.insert(700, {"ts": 5, "master_metadata_track_name": "}" * 20_000})
    files = {
        "Streaming_History_Audio_1.json": json.dumps(long),
        "Streaming_History_Audio_2.json": json.dumps(long[:300], indent=2, ensure_ascii=False) + "\n",
        "StreamingHistory_podcast_0.json": json.dumps([{"ts": 1, "show_name": "one"}]),
        "StreamingHistory_podcast_1.json": " [ \n ] ",
        "StreamingHistory_podcast_2.json": json.dumps([[], [{}], "x"] * 3000),
        "Userdata.json": json.dumps([{"ts": 1}]),
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_split_reader_equals_whole_reader(spark, tmp_path, small_ranges):
    path = exports(tmp_path)
    split = history.read_parsed(spark, path, whole_bytes=0).drop("file_path")
    whole = history.read_parsed(spark, path)
    assert whole.count() == 2006 + 300 + 1 + 9000
    assert sorted(map(str, history.plays_of(split).collect())) == sorted(map(str, history.plays_of(whole).collect()))
    got, want = (
        sorted((r.file_source, r.pos, r.reason, json.dumps(json.loads(r.content))) for r in history.rejects_of(x).collect())
        for x in (split, whole)
    )
    assert got == want
    # A file in the middle of both ways.
    mixed = history.read_parsed(spark, path, whole_bytes=100_000)
    assert sorted(map(str, history.plays_of(mixed).collect())) == sorted(map(str, history.plays_of(whole).collect()))


def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    path = exports(tmp_path)
    rows = arrays.fragments(spark, path, 0).where("file_source = 'Streaming_History_Audio_1.json'")
    assert rows.rdd.getNumPartitions() > 20
    ranges = arrays.ranges(rows).collect()
    assert len(ranges) > 20
    entries = {r["start"]: r for r in arrays.entries(arrays.ranges(rows)).collect()}
    assert any(r["inside"] for r in entries.values()) and {r["depth"] for r in entries.values()} >= {0, 1}
    assert [r["before"] for _, r in sorted(entries.items())] == sorted(r["before"] for r in entries.values())
    assert sum(r["last"] for r in entries.values()) == 1


@pytest.mark.parametrize(
    "text,plays,reasons",
    [
        ('[{"ts": 1}, {"ts": 2}', 2, ["array is not closed"]),
        ('[{"ts": 1}, {"ts": 2', 1, ["array is not closed", "unreadable element"]),
        ('[{"ts": 1}, {"ts": oops}, {"ts": 3}]', 2, ["unreadable element"]),
        ('[{"ts": 1}] [{"ts": 2}]', 1, ["text after the array"]),
        ('[{"ts": 1},]', 1, ["unreadable element"]),
        ('{"ts": [1, 2]}', 0, ["file is no array"]),
        ("not json", 0, ["file is no array"]),
        ('[{"ts": 1}', 1, ["array is not closed"]),
        ("[]", 0, []),
        ("[ 5 ]", 0, ["element is not an object"]),
        (" ", 0, []),
    ],
)
def test_remarks(spark, tmp_path, text, plays, reasons):
    (tmp_path / "Streaming_History_Audio.json").write_text(text)
    found = history.read_parsed(spark, str(tmp_path), whole_bytes=0)
    assert history.plays_of(found).count() == plays
    assert sorted(r.reason for r in history.rejects_of(found).collect()) == reasons


def test_an_endless_element_is_cut(spark, tmp_path, monkeypatch):
    cutter = arrays.Cutter(0, None, 0, 0, 0)
    monkeypatch.setattr(arrays, "LONGEST", 5000)
    parts = [b'[{"a": "'] + [b"x" * 700] * 100 + [b'"}, {"b": 1}]']
    found = [p for part in parts for p in cutter.feed(part)]
    assert [(p, w, len(t)) for p, w, t in found] == [(0, True, arrays.KEPT + 1), (1, True, 9)]
    assert found[0][2].endswith(b"\0")


def test_a_file_behind_a_join_comes_from_one_task(spark):
    """Adaptive execution turns the join into a broadcast and reads its shuffle by mapper."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    settings |= {"spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as with much data
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        name = F.concat(F.lit("file_"), F.col("id") % 2, F.lit(".json"))
        lines = spark.range(0, 4000, 1, 4).select(name.alias("file_source"), F.col("id").alias("ord"))
        ends = lines.groupBy("file_source").agg(F.max("ord").alias("last"))
        text = F.concat("ord", F.when(F.col("ord") == F.col("last"), "]").otherwise(","))
        folder = export_folder(spark, lines.join(ends, "file_source").select("file_source", "ord", text.alias("text")))
        found = {r.name: r.value for r in spark.read.text(folder, wholetext=True).select("value", "_metadata.file_name").toDF("value", "name").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert set(found) == {"file_0.json", "file_1.json"}
    for k in (0, 1):
        assert found[f"file_{k}.json"] == ",\n".join(map(str, range(k, 4000, 2))) + "]\n"


def test_a_task_reads_many_ranges(spark, tmp_path, small_ranges):
    items = [{"ts": k, "x": "}" * 50} if k % 9 else k for k in range(20_000)]
    (tmp_path / "Streaming_History_Audio.json").write_text(json.dumps(items))
    rows = arrays.fragments(spark, str(tmp_path), 0)
    assert arrays.ranges(rows).count() > 200
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("most", [0, 50_000])
def test_entries_reach_ranges_with_and_without_a_shuffle(spark, tmp_path, small_ranges, monkeypatch, most):
    monkeypatch.setattr(arrays, "BROADCAST_RANGES", most)
    path = exports(tmp_path)
    split, whole = history.read_parsed(spark, path, whole_bytes=0), history.read_parsed(spark, path)
    assert sorted(map(str, history.plays_of(split).collect())) == sorted(map(str, history.plays_of(whole).collect()))
    places = [sorted((r.file_source, r.pos, r.reason) for r in history.rejects_of(x).collect()) for x in (split, whole)]
    assert places[0] == places[1]
