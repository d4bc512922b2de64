"""Stages that are killed half way, and what readers see."""

import json

import pytest
from pyspark.sql import functions as F

from playtrail.plans import pipeline
from playtrail.sinks import versions, writers
from playtrail.sources.tables import load_enriched


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, kind in (("Streaming_History_Audio_1.json", "master_metadata_track_name"), ("StreamingHistory_podcast_1.json", "episode_name")):
        plays = [{"ts": 1_600_000_000 + 5_000 * k, "ms_played": 1000 * k, kind: f"t{k % 7}"} for k in range(60)]
        (folder / name).write_text(json.dumps(plays))
    return str(folder)


def test_versions_appear_when_complete(spark, tmp_path):
    root = str(tmp_path / "out")
    assert versions.current(spark, root) == root
    with pytest.raises(RuntimeError):
        with versions.new_version(spark, root) as folder:
            spark.range(1).write.parquet(f"{folder}/a")
            raise RuntimeError("killed")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root)
    for n in (2, 3, 4):
        with versions.new_version(spark, root) as folder:
            spark.range(n).write.parquet(f"{folder}/a")
        assert versions.current(spark, root) == folder
        assert spark.read.parquet(f"{versions.current(spark, root)}/a").count() == n
    assert len(versions.remove_old(spark, root, keep=2)) == 2
    assert len(versions.published(spark, root)) == 2
    assert spark.read.parquet(f"{versions.current(spark, root)}/a").count() == 4


def test_a_killed_stage_leaves_the_former_version(spark, raw, tmp_path, monkeypatch):
    folders = [str(tmp_path / n) for n in ("processed", "enriched", "results")]

    def run(stages=("parse", "enrich")):
        pipeline.run(spark, raw, *folders, stages=stages, versioned=True)

    def daily():
        data = load_enriched(spark, folders[1])
        return data.plays.count(), data.rollups["daily_stats"].agg(F.sum("plays")).first()[0], data.summary is not None

    write_table, written = writers.write_table, []

    def killed(table, path, name):
        if name == "artist_stats":
            raise KeyboardInterrupt
        written.append(name)
        return write_table(table, path, name)

    monkeypatch.setattr(writers, "write_table", killed)
    with pytest.raises(KeyboardInterrupt):
        run()
    assert "daily_stats" in written
    with pytest.raises(FileNotFoundError):
        load_enriched(spark, folders[1])
    monkeypatch.setattr(writers, "write_table", write_table)
    run(("enrich",))
    assert daily() == (120, 120, True)

    # One more file; the next attempt dies between two tables, and nobody sees its half.
    with open(f"{raw}/Streaming_History_Video_1.json", "w") as f:
        json.dump([{"ts": 1_600_000_000, "video_name": "v"}], f)
    monkeypatch.setattr(writers, "write_table", killed)
    with pytest.raises(KeyboardInterrupt):
        run(("enrich",))
    assert daily() == (120, 120, True)
    monkeypatch.setattr(writers, "write_table", write_table)
    run()
    assert daily() == (121, 121, True)
