"""Reading export directories."""

import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import ingest_checks
from playtrail.plans import pipeline
from playtrail.session import work_folder
from playtrail.sinks.layout import REJECTS, STATISTICS
from playtrail.sources import history
from playtrail.streaming.history import append_new_plays, stream_history


@pytest.fixture
def exports(tmp_path):
    def put(name, content):
        text = content if isinstance(content, str) else json.dumps(content)
        (tmp_path / name).write_text(text)

    put(
        "Streaming_History_Audio_2023.json",
        [
            {"ts": "2019-07-23T04:56:07Z", "ms_played": 98765, "master_metadata_track_name": "S",
             "master_metadata_album_artist_name": "A", "master_metadata_album_album_name": "B",
             "spotify_track_uri": "u", "shuffle": False, "skipped": True, "platform": "ios",
             "conn_country": "NZ"},
            {"ts": 1704067200, "ms_played": None, "master_metadata_track_name": None},
            7,
            None,
            "text",
            [1],
            {},
        ],
    )
    put("StreamingHistory_podcast_0.json", [{"ts": 1704067200000, "show_name": "P", "shuffle": True}])
    put("StreamingHistory_audiobook_0.json", [{"chapter_name": "c", "offline_timestamp": 1704067200}])
    put("Streaming_History_Video_0.json", "[{\"ts\": ")
    put("Streaming_History_Video_1.json", {"ts": 1})
    put("Streaming_History_Video_2.json", " ")
    put("Userdata.json", [{"ts": 1}])
    put("Streaming_History_Audio_note.txt", [{"ts": 1}])
    return str(tmp_path)


def test_discovery(spark, exports):
    found = {r.file_source: r.content_type for r in history.discover_files(spark, exports).collect()}
    assert found == {
        "Streaming_History_Audio_2023.json": "music",
        "StreamingHistory_podcast_0.json": "podcast",
        "StreamingHistory_audiobook_0.json": "audiobook",
        "Streaming_History_Video_0.json": "video",
        "Streaming_History_Video_1.json": "video",
        "Streaming_History_Video_2.json": "video",
        "Userdata.json": "other",
    }


def test_missing_directory_is_empty(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert history.read_history(spark, str(tmp_path / "none")).count() == 0
    with pytest.warns(UserWarning):
        assert history.discover_files(spark, str(tmp_path / "none")).count() == 0


def test_records_and_defaults(spark, exports):
    rows = history.read_history(spark, exports).collect()
    music = [r for r in rows if r.content_type == "music"]
    full = next(r for r in music if r.track_name == "S")
    assert full.timestamp == datetime(2019, 7, 23, 4, 56, 7)
    assert (full.artist_name, full.album_name, full.track_uri) == ("A", "B", "u")
    assert (full.ms_played, full.shuffle, full.skipped, full.country) == (98765, False, True, "NZ")
    null = next(r for r in music if r.track_name is None)
    assert (null.ms_played, null.artist_name) == (None, "Unknown Artist")
    empty = next(r for r in music if r.track_name == "Unknown Track")
    assert (empty.ms_played, empty.ts_status, empty.timestamp) == (0, "missing", None)
    assert len(music) == 3
    podcast = next(r for r in rows if r.content_type == "podcast")
    assert (podcast.track_name, podcast.artist_name, podcast.album_name) == ("Unknown Episode", "P", "P")
    assert podcast.shuffle is None and podcast.timestamp == datetime(2024, 1, 1)
    book = next(r for r in rows if r.content_type == "audiobook")
    assert (book.artist_name, book.album_name) == ("Unknown Book", None)
    assert book.offline_timestamp == datetime(2024, 1, 1)
    assert len(rows) == 5 and len({r.play_id for r in rows}) == 5


def test_rejects(spark, exports):
    rejects = history.rejected(history.read_history_texts(spark, exports)).collect()
    files = sorted(r.file_source for r in rejects if r.pos is None)
    assert files == ["Streaming_History_Video_0.json", "Streaming_History_Video_2.json"]
    odd = sorted((r.pos, r.content) for r in rejects if r.pos is not None)
    assert odd == [(2, "7"), (3, "null"), (4, '"text"'), (5, "[1]")]


STAMP = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "raw,want,status",
    [
        (1704067200, STAMP, "ok"),
        (1704067200000, STAMP, "ok"),
        (1704067200.5, datetime(2024, 1, 1, 0, 0, 0, 500000), "ok"),
        (10_000_000_000, datetime(2286, 11, 20, 17, 46, 40), "ok"),
        (10_000_000_001, datetime(1970, 4, 26, 17, 46, 40, 1000), "ok"),
        ("1704067200", STAMP, "ok"),
        (" 1704067200000 ", STAMP, "ok"),
        ("0", datetime(1970, 1, 1), "ok"),
        ("2024-01-01T00:00:00Z", STAMP, "ok"),
        (" 2024-01-01T02:00:00+02:00", STAMP, "ok"),
        ("2023-12-31T19:00:00-05:00", STAMP, "ok"),
        ("2024-01-01T00:00:00", STAMP, "ok"),
        ("2024-01-01 00:00:00", STAMP, "ok"),
        ("soon", None, "invalid"),
        ("2024-01-01 soon", None, "invalid"),
        ("2024-01-01e5", None, "invalid"),
        ("T12:00", None, "invalid"),
        ("nan", None, "invalid"),
        (1e300, None, "invalid"),
        ([1], None, "invalid"),
        (True, None, "invalid"),
        ("", None, "missing"),
        ("  ", None, "missing"),
        (0, None, "missing"),
        (False, None, "missing"),
        (None, None, "missing"),
        ({}, None, "missing"),
    ],
)
def test_timestamps(spark, raw, want, status):
    text = json.dumps([{"ts": raw}])
    files = spark.createDataFrame(
        [("streaming_history_audio.json", "f", text)], "file_source string, file_path string, text string"
    )
    row = history.parse_history(files).first()
    assert (row.timestamp, row.ts_status) == (want, status)


def test_bad_timestamps_can_get_a_value(spark):
    files = spark.createDataFrame(
        [("streaming_history_audio.json", "f", '[{"ts": "x"}]')],
        "file_source string, file_path string, text string",
    )
    stand_in = F.to_timestamp(F.lit("2000-01-01 00:00:00"))
    assert history.parse_history(files, stand_in).first().timestamp == datetime(2000, 1, 1)


def _files(spark, *texts):
    rows = [("streaming_history_audio.json", f"f{k}", text) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "file_source string, file_path string, text string")


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_is_asked_for_is_converted(spark):
    plays = history.parse_history(_files(spark, "[]"))
    times = _optimized(plays.select("track_uri", "timestamp", "ts_status", "offline_timestamp"))
    assert "offline_timestamp" in times and "master_metadata_track_name" not in times
    # The other fields once: filters ask the struct of the times whether there is an object.
    assert _optimized(plays).count("StructField(ms_played,") == 1


def test_odd_elements_and_uris_keep_their_rows(spark):
    uris = ["u", "u", None, 7, 1.5, True, [1], {"a": 1}, ""]
    elements = [{"ts": 1704067200, "spotify_track_uri": u} for u in uris]
    files = _files(spark, json.dumps([*elements, {}, None, 7, "text", [{"ts": 1}]]), "[]", None, '{"ts": 1}', "[1,")
    plays = history.parse_history(files)
    got = sorted((r.track_uri for r in plays.where("timestamp IS NOT NULL").collect()), key=str)
    assert got == sorted(["u", "u", None, "7", "1.5", "true", "[1]", '{"a":1}', ""], key=str)
    assert plays.where("ts_status = 'missing'").count() == 1
    rejects = sorted((str(r.pos), r.reason, str(r.content)) for r in history.rejected(files).collect())
    odd = [("10", "null"), ("11", "7"), ("12", '"text"'), ("13", '[{"ts":1}]')]
    unreadable = [("None", "unreadable file", "None")] * 2
    assert rejects == sorted([*((p, "element is not an object", c) for p, c in odd), *unreadable])


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"ts": 1704067200 + i, "ms_played": i}) for i in range(50)] + ["oops", "3"]
    (tmp_path / "Streaming_History_Audio.jsonl").write_text("\n".join(lines))
    plays = history.read_history_lines(spark, str(tmp_path))
    rejects = history.rejected_lines(spark, str(tmp_path)).collect()
    assert {(r.reason, r.content) for r in rejects} == {
        ("unreadable line", "oops"),
        ("element is not an object", "3"),
    }
    again = history.read_history_lines(spark, str(tmp_path))
    assert sorted(r.play_id for r in again.collect()) == sorted(r.play_id for r in plays.collect())
    assert plays.count() == 50
    assert plays.agg(F.sum("ms_played")).first()[0] == sum(range(50))


def test_incremental_reading(spark, exports, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(n)) for n in ("plays", "state"))
    for _ in range(2):
        query = append_new_plays(stream_history(spark, exports), f"{out}/t", state)
        query.awaitTermination()
    batch = history.read_history(spark, exports)
    assert spark.read.parquet(f"{out}/t").count() == batch.count()


@pytest.fixture
def many_files(spark, tmp_path):
    """300 files, each a task for itself by Spark's settings."""
    for k in range(300):
        items = [{"ts": 1704067200 + k, "ms_played": k, "master_metadata_track_name": "t" * 5000}, k]
        (tmp_path / f"Streaming_History_Audio_{k}.json").write_text(json.dumps(items))
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_discovery_takes_many_files_to_a_task(spark, many_files):
    found = history.discover_files(spark, many_files)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert len({r.file_path for r in found.collect()}) == found.count() == 300


def test_texts_are_read_many_to_a_task(spark, many_files):
    texts = history.read_history_texts(spark, many_files, 1 << 20)
    assert texts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r.file_source, len(r.text) > 5000) for r in texts.collect()} == {
        (f"Streaming_History_Audio_{k}.json", True) for k in range(300)
    }
    assert history.read_history(spark, many_files).agg(F.sum("ms_played")).first()[0] == sum(range(300))


def test_parse_lists_its_files_once_and_writes_few(spark, many_files, tmp_path_factory, monkeypatch):
    asked = []
    found = lambda *a, **b: asked.append(a) or discover(*a, **b)
    discover = history.discover_files
    monkeypatch.setattr(history, "discover_files", found)
    monkeypatch.setattr(pipeline, "discover_files", found)
    out = tmp_path_factory.mktemp("parsed")
    assert pipeline.parse(spark, many_files, str(out)).count() == 300
    assert len(asked) == 1
    assert spark.read.json(f"{out}/{STATISTICS}").first().total_files == 300


def test_rejects_of_many_files_are_few_files(spark, many_files, tmp_path_factory):
    out = tmp_path_factory.mktemp("parsed")
    pipeline.parse(spark, many_files, str(out))
    rejects = spark.read.parquet(f"{out}/{REJECTS}.parquet")
    assert sorted(int(r.content) for r in rejects.collect()) == [*range(300)]
    assert len(list(out.glob(f"{REJECTS}.parquet/part-*"))) <= 4 * spark.sparkContext.defaultParallelism


def test_a_run_stores_its_elements_in_few_files(spark, many_files, tmp_path_factory):
    out, folder = tmp_path_factory.mktemp("run"), Path(work_folder(spark).removeprefix("file:"))
    before = {*folder.glob("parsed_elements-*")}
    pipeline.run(spark, many_files, *(f"{out}/{n}" for n in ("processed", "enriched", "results")), stages=("parse",))
    (stored,) = {*folder.glob("parsed_elements-*")} - before
    assert len(list(stored.glob("part-*"))) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(stored)).count() == 600


def test_exports_written_by_tasks_are_those_of_sparks_writer(spark, tmp_path):
    name = F.when(F.col("id") % 7 != 6, F.concat(F.lit("file_"), F.col("id") % 7, F.lit(".json")))
    text = F.when(F.col("id") % 5 != 0, F.concat(F.lit("é "), "id"))
    lines = spark.range(0, 700, 1, 4).select(name.alias("file_source"), (-F.col("id")).alias("ord"), text.alias("text"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(tmp_path))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = lines.where("file_source IS NOT NULL").repartition("file_source").sortWithinPartitions("file_source", "ord")
    ingest_checks._spark_files(spark, rows.select("file_source", "text"), str(tmp_path), files)
    folder = Path(ingest_checks.export_folder(spark, lines).removeprefix("file:"))
    want = {p.name: p.read_bytes() for p in tmp_path.glob("*.json")}
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == want and len(want) == 6
    assert want["file_1.json"].startswith("é 694\né 687\n".encode())
    # Each row a file.
    one = ingest_checks.export_folder(spark, lines.where("ord > -6").drop("ord"), whole=True)
    assert {p.name for p in Path(one.removeprefix("file:")).iterdir()} == {*want}
