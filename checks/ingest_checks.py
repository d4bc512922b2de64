"""Parsing exports.  Spark renders the events table as export files (text), oddities
included, and the parser reads those; the SQL states the expected plays."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.adapters import read
from checks.registry import ORACLES, check
from playtrail.plans import pipeline
from playtrail.plans.rollups import (
    PARSE_COUNTS,
    parse_statistics,
    top_artists_by_plays,
    value_counts,
)
from playtrail.session import work_folder
from playtrail.sinks.layout import REJECTS, STATISTICS
from playtrail.sinks.writers import write_plays
from playtrail.sources import history
from playtrail.sources.tables import read_plays

ELEMENTS_PER_FILE = 500
FILE_NAMES = {
    "click": "Streaming_History_Audio",
    "signup": "Streaming_History_Video",
    "view": "StreamingHistory_podcast",
    "purchase": "StreamingHistory_audiobook",
    "error": "notes",
}


def export_elements(spark, sf) -> DataFrame:
    """``(event_id, event_type, prefix, x)``: each event as the text of an export's element, and
    the beginning of its file's name.

    Every 101st element is a bare number, every 17th lacks names and length, every 19th
    has them as null.
    """
    e = read(spark, sf, "events")
    n, us = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))

    def iso(shift_hours: int, suffix: str):
        shifted = F.timestamp_micros(us + shift_hours * 3_600_000_000)
        text = F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.lit('"ts":"'), text, F.lit(suffix + '",'))

    fraction = F.lpad((us % 1_000_000).cast("string"), 6, "0")
    second = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    milli = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    spelling = (
        F.when(n % 9 == 0, iso(0, "Z"))
        .when(n % 9 == 1, F.concat(F.lit('"ts":'), second, F.lit("."), fraction, F.lit(",")))
        .when(n % 9 == 2, F.concat(F.lit('"ts":'), milli, F.lit(",")))
        .when(n % 9 == 3, F.concat(F.lit('"ts":"'), second, F.lit('",')))
        .when(n % 9 == 4, iso(2, "+02:00"))
        .when(n % 9 == 5, iso(-5, "-05:00"))
        .when(n % 9 == 6, iso(0, ""))
        .when(n % 9 == 7, F.lit('"ts":"not a time",'))
        .otherwise(F.when(n % 2 == 0, F.lit('"ts":"",')).otherwise(F.lit("")))
    )
    blank = (n % 17 == 0) | (n % 19 == 0)

    def name(kind: str, part: str):
        text = F.concat(F.lit(part + " "), (n % 50).cast("string"))
        return F.when((F.col("event_type") == kind) & ~blank, text)

    fields = []
    for kind, names in (
        (
            "click",
            (
                "master_metadata_track_name",
                "master_metadata_album_artist_name",
                "master_metadata_album_album_name",
            ),
        ),
        ("view", ("episode_name", "show_name")),
        ("purchase", ("chapter_name", "book_name")),
        ("signup", ("video_name", "channel_name")),
    ):
        fields += [name(kind, part).alias(field) for field, part in zip(names, "tab")]
    uri = F.concat(F.lit("uri:"), n.cast("string"))
    fields += [
        F.when(F.col("event_type") == "click", uri).alias("spotify_track_uri"),
        F.when(F.col("event_type").isin("view", "purchase"), uri).alias("spotify_episode_uri"),
        F.when(F.col("event_type") == "signup", uri).alias("spotify_video_uri"),
        F.when(~blank, F.round(F.col("value") * 4000).cast("bigint")).alias("ms_played"),
        (n % 2 == 0).alias("shuffle"),
        F.when(n % 3 != 0, n % 5 == 0).alias("skipped"),
        (n % 4 == 0).alias("offline"),
        F.when(n % 3 == 0, 0).when(n % 3 == 1, second).alias("offline_timestamp"),
        F.lit("android").alias("platform"),
        F.when(n % 6 != 0, "DE").alias("conn_country"),
        F.lit("done").alias("reason_end"),
    ]
    lean = F.to_json(F.struct(*fields))
    full = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    body = F.when((n % 19 == 0) & (n % 17 != 0), full).otherwise(lean)
    element = F.when(n % 101 == 0, n.cast("string")).otherwise(
        F.concat(F.lit("{"), spelling, F.substring(body, 2, 1 << 30))
    )
    prefix = F.create_map(*[F.lit(x) for pair in FILE_NAMES.items() for x in pair])
    return e.select(n, "event_type", prefix[F.col("event_type")].alias("prefix"), element.alias("x"))


def export_files(spark, sf) -> DataFrame:
    """``(file_source, file_path, text)``: up to 500 events of one type per file.  Some video
    files are garbage, some podcast files hold an object."""
    chunk = F.floor(F.col("event_id") / ELEMENTS_PER_FILE)
    file = F.concat("prefix", F.lit("_"), chunk, F.lit(".json"))
    files = (
        export_elements(spark, sf)
        .select(file.alias("file_source"), chunk.alias("chunk"), "event_type", "event_id", "x")
        .groupBy("file_source", "chunk", "event_type")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("items"))
    )
    array = F.concat(F.lit("["), F.array_join(F.col("items.x"), ", "), F.lit("]"))
    text = (
        F.when(_garbage(), F.concat(F.lit("not json "), array))
        .when(_wrapped(), F.concat(F.lit('{"items": '), array, F.lit("}")))
        .otherwise(array)
    )
    return files.select("file_source", F.col("file_source").alias("file_path"), text.alias("text"))


def export_folder(spark, lines: DataFrame, whole: bool = False) -> str:
    """A folder with one file for each ``file_source``, of its rows' ``text`` in the order of
    ``ord``; ``whole``: each row is a file.

    In a folder that all machines mount, the tasks write the files.  Elsewhere Spark does, and
    only their names are set from here, one after the other."""
    out = f"{work_folder(spark)}/exports-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    rows = lines.where("file_source IS NOT NULL")
    if not whole:
        # By a hash of the name, for a shuffle of its own: Spark takes one by the name for that of
        # a join before, whose partitions it deals out anew, and a file would come from many tasks.
        rows = rows.repartition(F.xxhash64("file_source")).sortWithinPartitions("file_source", "ord")
    rows = rows.select("file_source", "text")
    if files.getUri().getScheme() == "file":
        local = files.makeQualified(folder).toUri().getPath()
        rows.mapInArrow(_file_writer(local), "file_source string").write.format("noop").mode("overwrite").save()
    else:
        _spark_files(spark, rows, out, files)
    return out


def _file_writer(folder: str):
    """Writes rows ``(file_source, text)``, a line each, a file's together, and returns the names.
    A file gets its name when it is complete, so a task may run twice."""

    def write(batches):
        name = file = None
        for batch in batches:
            done = []
            for of, text in zip(*(batch.column(n).to_pylist() for n in ("file_source", "text"))):
                if of != name:
                    if file:
                        file.close()
                        os.replace(file.name, f"{folder}/{name}")
                    file = open(f"{folder}/.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
                    name = of
                    done.append(of)
                file.write((text or "").encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file_source"])
        if file:
            file.close()
            os.replace(file.name, f"{folder}/{name}")

    return write


def _spark_files(spark, rows: DataFrame, out: str, files) -> None:
    """The same by Spark's writer."""
    rows.write.partitionBy("file_source").text(f"{out}/parts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in files.listStatus(path(f"{out}/parts")):
        _, _, name = folder.getPath().getName().partition("=")
        if name:
            (part,) = files.listStatus(folder.getPath())
            files.rename(part.getPath(), path(f"{out}/{name}"))
    files.delete(path(f"{out}/parts"), True)


def whole_files(spark, sf) -> str:
    """`export_files` as a folder."""
    return export_folder(spark, export_files(spark, sf), whole=True)


def _class_files(spark, sf) -> DataFrame:
    """All elements of a class for one file, in the order of events."""
    name = F.concat("prefix", F.lit("_all.json"))
    return export_elements(spark, sf).select(name.alias("file_source"), F.col("event_id").alias("ord"), F.col("x").alias("text"))


def array_folder(spark, sf) -> str:
    """One array for each class, however many events there are."""
    rows = _class_files(spark, sf)
    ends = rows.groupBy("file_source").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    at = F.col("ord")
    framed = F.concat(
        F.when(at == F.col("first"), "[").otherwise(","), "text", F.when(at == F.col("last"), "]").otherwise("")
    )
    return export_folder(spark, rows.join(ends, "file_source").select("file_source", "ord", framed.alias("text")))


def line_folder(spark, sf) -> str:
    """The same elements one a line; every 103rd line is cut short."""
    text = F.when(F.col("ord") % 103 == 0, F.expr("left(text, 3)")).otherwise(F.col("text"))
    return export_folder(spark, _class_files(spark, sf).withColumn("text", text))


@contextmanager
def file_ranges(spark, size: int):
    """Ranges of so many bytes, so that the test tables' files have many."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _garbage():
    return (F.col("event_type") == "signup") & (F.col("chunk") % 4 == 3)


def _wrapped():
    return (F.col("event_type") == "view") & (F.col("chunk") % 5 == 4)


SOURCE_SQL = """
source AS (
  SELECT *, event_id // 500 AS chunk, event_id % 17 = 0 AS absent,
    event_id % 19 = 0 AND event_id % 17 <> 0 AS is_null,
    CASE event_type WHEN 'click' THEN 'music' WHEN 'signup' THEN 'video'
      WHEN 'view' THEN 'podcast' WHEN 'purchase' THEN 'audiobook' ELSE 'other' END AS content_type,
    CASE event_type WHEN 'click' THEN 'Streaming_History_Audio'
      WHEN 'signup' THEN 'Streaming_History_Video' WHEN 'view' THEN 'StreamingHistory_podcast'
      WHEN 'purchase' THEN 'StreamingHistory_audiobook' ELSE 'notes' END
      || '_' || (event_id // 500) || '.json' AS file_source
  FROM events),
readable AS (
  SELECT * FROM source WHERE content_type <> 'other'
    AND NOT (event_type = 'signup' AND chunk % 4 = 3) AND NOT (event_type = 'view' AND chunk % 5 = 4)),
parsed AS (
  SELECT event_id, content_type, file_source,
    CASE WHEN event_id % 9 IN (7, 8) THEN NULL WHEN event_id % 9 = 2 THEN date_trunc('millisecond', ts)
      WHEN event_id % 9 = 3 THEN date_trunc('second', ts) ELSE ts END AS timestamp,
    CASE event_id % 9 WHEN 7 THEN 'invalid' WHEN 8 THEN 'missing' ELSE 'ok' END AS ts_status,
    CASE WHEN is_null THEN NULL WHEN absent THEN CASE content_type WHEN 'music' THEN 'Unknown Track'
        WHEN 'podcast' THEN 'Unknown Episode' WHEN 'audiobook' THEN 'Unknown Chapter'
        ELSE 'Unknown Video' END
      ELSE 't ' || (event_id % 50) END AS track_name,
    CASE WHEN is_null THEN NULL WHEN absent THEN CASE content_type WHEN 'music' THEN 'Unknown Artist'
        WHEN 'podcast' THEN 'Unknown Show' WHEN 'audiobook' THEN 'Unknown Book'
        ELSE 'Unknown Channel' END
      ELSE 'a ' || (event_id % 50) END AS artist_name,
    CASE WHEN is_null OR absent THEN NULL WHEN content_type = 'music' THEN 'b ' || (event_id % 50)
      ELSE 'a ' || (event_id % 50) END AS album_name,
    'uri:' || event_id AS track_uri,
    CASE WHEN is_null THEN NULL WHEN absent THEN 0
      ELSE CAST(round(value * 4000) AS BIGINT) END AS ms_played,
    CASE WHEN content_type = 'music' THEN event_id % 2 = 0 END AS shuffle,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 5 = 0 END AS skipped,
    event_id % 4 = 0 AS offline,
    CASE WHEN event_id % 3 = 1 THEN date_trunc('second', ts) END AS offline_timestamp,
    CAST(NULL AS BOOLEAN) AS incognito_mode, 'android' AS platform,
    CAST(NULL AS VARCHAR) AS user_agent, CAST(NULL AS VARCHAR) AS ip_address,
    CASE WHEN event_id % 6 <> 0 THEN 'DE' END AS country,
    CAST(NULL AS VARCHAR) AS reason_start, 'done' AS reason_end
  FROM readable WHERE event_id % 101 <> 0)"""


# The same events in one file for each class, all of them readable.
CLASS_SOURCE_SQL = SOURCE_SQL.replace("'_' || (event_id // 500) || '.json'", "'_all.json'").replace(
    """
    AND NOT (event_type = 'signup' AND chunk % 4 = 3) AND NOT (event_type = 'view' AND chunk % 5 = 4)""", ""
)
assert CLASS_SOURCE_SQL.count("_all.json") == 1 and "AND NOT (event" not in CLASS_SOURCE_SQL


def _class_sql(select: str) -> str:
    return f"WITH {CLASS_SOURCE_SQL}\n{select}"


def _plays(spark, sf) -> DataFrame:
    return history.parse_history(export_files(spark, sf))


def _parsed_sql(select: str) -> str:
    return f"WITH {SOURCE_SQL}\n{select}"


@check(
    "file_classes",
    _parsed_sql(
        """SELECT content_type, count(DISTINCT file_source) AS files FROM source
GROUP BY content_type"""
    ),
)
def file_classes(spark, sf):
    kinds = export_files(spark, sf).select(
        history.file_class(F.col("file_source")).alias("content_type")
    )
    return kinds.groupBy("content_type").agg(F.count(F.lit(1)).alias("files"))


@check("parse_all", _parsed_sql("SELECT * EXCLUDE (event_id) FROM parsed"))
def parse_all(spark, sf):
    return _plays(spark, sf).drop("play_id")


@check("parsed_round_trip", _parsed_sql("SELECT * EXCLUDE (event_id) FROM parsed"))
def parsed_round_trip(spark, sf):
    """Parsed plays written and read back."""
    out = f"{work_folder(spark)}/parsed-{uuid.uuid4().hex}"
    return read_plays(spark, write_plays(_plays(spark, sf), out)).drop("play_id")


def _of_class(kind: str) -> str:
    return _parsed_sql(f"SELECT * EXCLUDE (event_id) FROM parsed WHERE content_type = '{kind}'")


@check("parse_music", _of_class("music"))
def parse_music(spark, sf):
    return _plays(spark, sf).filter("content_type = 'music'").drop("play_id")


@check("parse_podcast", _of_class("podcast"))
def parse_podcast(spark, sf):
    return _plays(spark, sf).filter("content_type = 'podcast'").drop("play_id")


@check("parse_audiobook", _of_class("audiobook"))
def parse_audiobook(spark, sf):
    return _plays(spark, sf).filter("content_type = 'audiobook'").drop("play_id")


@check("parse_video", _of_class("video"))
def parse_video(spark, sf):
    return _plays(spark, sf).filter("content_type = 'video'").drop("play_id")


@check(
    "parse_timestamps",
    _parsed_sql(
        """SELECT track_uri, timestamp, ts_status, offline_timestamp,
  coalesce(timestamp, TIMESTAMP '2000-01-01 00:00:00') AS filled FROM parsed"""
    ),
)
def parse_timestamps(spark, sf):
    files = export_files(spark, sf)
    stand_in = F.timestamp_micros(F.lit(946_684_800_000_000))
    strict = history.parse_history(files)
    filled = history.parse_history(files, stand_in).select(
        "track_uri", F.col("timestamp").alias("filled")
    )
    columns = ["track_uri", "timestamp", "ts_status", "offline_timestamp"]
    return strict.select(*columns).join(filled, "track_uri")


@check(
    "rejected_elements",
    _parsed_sql(
        """SELECT file_source,
  CAST(row_in_file AS INTEGER) AS pos, 'element is not an object' AS reason,
  CAST(event_id AS VARCHAR) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY file_source ORDER BY event_id) - 1 AS row_in_file
      FROM readable) WHERE event_id % 101 = 0
UNION ALL
SELECT DISTINCT file_source, CAST(NULL AS INTEGER), 'unreadable file', CAST(NULL AS VARCHAR)
FROM source WHERE event_type = 'signup' AND chunk % 4 = 3"""
    ),
)
def rejected_elements(spark, sf):
    return history.rejected(export_files(spark, sf))


@check(
    "parse_statistics",
    _parsed_sql(
        """SELECT (SELECT count(DISTINCT file_source) FROM source) AS total_files,
  count(*) AS total_records, count(*) FILTER (content_type = 'music') AS music_records,
  count(*) FILTER (content_type = 'podcast') AS podcast_records,
  count(*) FILTER (content_type = 'audiobook') AS audiobook_records,
  count(*) FILTER (content_type = 'video') AS video_records,
  (SELECT count(*) FROM readable WHERE event_id % 101 = 0)
  + (SELECT count(DISTINCT file_source) FROM source
     WHERE event_type = 'signup' AND chunk % 4 = 3) AS errors,
  min(timestamp) AS start, max(timestamp) AS "end"
FROM parsed"""
    ),
)
def parsing_statistics(spark, sf):
    files = export_files(spark, sf)
    return parse_statistics(history.parsed(history.file_elements(files)), files)


@check(
    "parse_profile_types",
    _parsed_sql("SELECT content_type, count(*) AS n FROM parsed GROUP BY content_type"),
)
def parse_profile_types(spark, sf):
    return value_counts(_plays(spark, sf), "content_type")


@check(
    "parse_profile_artists",
    _parsed_sql(
        """SELECT artist_name, count(*) AS n FROM parsed WHERE artist_name IS NOT NULL
GROUP BY artist_name ORDER BY n DESC, artist_name LIMIT 10"""
    ),
)
def parse_profile_artists(spark, sf):
    return top_artists_by_plays(_plays(spark, sf))


# --- folders of files --------------------------------------------------------------


@check(
    "discovered_files",
    _parsed_sql("SELECT DISTINCT file_source, content_type, TRUE AS has_content FROM source"),
)
def discovered_files(spark, sf):
    files = history.discover_files(spark, whole_files(spark, sf))
    return files.select("file_source", "content_type", (F.col("length") > 0).alias("has_content"))


@check(
    "parse_split_arrays",
    _class_sql("SELECT * EXCLUDE (event_id), TRUE AS own_id FROM parsed"),
)
def parse_split_arrays(spark, sf):
    """Each class is one array, read in ranges of 16 KB; an id belongs to one play."""
    folder = array_folder(spark, sf)
    with file_ranges(spark, 1 << 14):
        plays = history.read_history(spark, folder, whole_bytes=0)
    alone = F.count(F.lit(1)).over(Window.partitionBy("play_id")) == 1
    return plays.withColumn("own_id", alone).drop("play_id")


@check(
    "rejected_split_arrays",
    _class_sql(
        """SELECT file_source, row_in_file AS pos, 'element is not an object' AS reason,
  CAST(event_id AS VARCHAR) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY file_source ORDER BY event_id) - 1 AS row_in_file
      FROM readable) WHERE event_id % 101 = 0"""
    ),
)
def rejected_split_arrays(spark, sf):
    folder = array_folder(spark, sf)
    with file_ranges(spark, 1 << 14):
        return history.rejects_of(history.read_parsed(spark, folder, whole_bytes=0))


@check(
    "parse_lines",
    _class_sql("SELECT * EXCLUDE (event_id) FROM parsed WHERE event_id % 103 <> 0"),
)
def parse_lines(spark, sf):
    return history.read_history_lines(spark, line_folder(spark, sf)).drop("play_id")


@check(
    "rejected_lines",
    _class_sql(
        """SELECT file_source, CAST(NULL AS BIGINT) AS pos,
  CASE WHEN event_id % 101 = 0 THEN 'element is not an object' ELSE 'unreadable line' END AS reason,
  CASE WHEN event_id % 101 <> 0 THEN '{"t' WHEN event_id % 103 = 0 THEN left(event_id::VARCHAR, 3)
    ELSE event_id::VARCHAR END AS content
FROM readable WHERE event_id % 101 = 0 OR event_id % 103 = 0"""
    ),
)
def rejected_lines(spark, sf):
    """What is left of a cut line begins like a time or, where there is none, like a name."""
    found = history.rejected_lines(spark, line_folder(spark, sf))
    content = F.when(F.col("reason") == "unreadable line", '{"t').otherwise(F.col("content"))
    return found.withColumn("content", content)


@check("pipeline_parse", _parsed_sql("SELECT * EXCLUDE (event_id) FROM parsed"))
def pipeline_parse(spark, sf):
    """The parse stage on a folder of files: its stored plays."""
    return pipeline.parse(spark, whole_files(spark, sf), _out(spark)).drop("play_id")


@check(
    "pipeline_parse_rejects",
    f"SELECT * REPLACE (CAST(pos AS BIGINT) AS pos) FROM ({ORACLES['rejected_elements']})",
)
def pipeline_parse_rejects(spark, sf):
    out = _out(spark)
    pipeline.parse(spark, whole_files(spark, sf), out)
    return spark.read.parquet(f"{out}/{REJECTS}.parquet")


@check("pipeline_parse_statistics", ORACLES["parse_statistics"])
def pipeline_parse_statistics(spark, sf):
    """Counts observed while the parsed elements were written."""
    out = _out(spark)
    pipeline.parse(spark, whole_files(spark, sf), out)
    return spark.read.schema(f"total_files bigint, {PARSE_COUNTS}").json(f"{out}/{STATISTICS}")


def _out(spark) -> str:
    return f"{work_folder(spark)}/parse-{uuid.uuid4().hex}"
