"""Play-history exports: JSON arrays (or JSON lines) of plays, one class per file.

Every element is kept as a VARIANT until its fields are picked, so a key that is
absent (default applies) differs from one that is null (stays null), and one bad
element does not cost the rest of its file.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.functions.timestamps import add_parsed_timestamp
from playtrail.schema import PLAYS_SCHEMA
from playtrail.sources.arrays import split_elements
from playtrail.sources.tasks import in_few_tasks

#: Text bytes of a file that one task reads whole.
WHOLE_BYTES = 64 << 20

# Substring of the lower-cased file name -> class, first match wins.
FILE_CLASSES = {
    "streaming_history_audio": "music",
    "streaming_history_video": "video",
    "streaminghistory_podcast": "podcast",
    "streaminghistory_audiobook": "audiobook",
}


@dataclass(frozen=True)
class ClassFields:
    """Where one class of files keeps what the plays table calls track, artist, album, uri."""

    track: str
    track_default: str
    artist: str
    artist_default: str
    album: str
    uri: str


# Field names and defaults of the export format, by class.
CLASS_FIELDS = {
    "music": ClassFields(
        track="master_metadata_track_name",
        track_default="Unknown Track",
        artist="master_metadata_album_artist_name",
        artist_default="Unknown Artist",
        album="master_metadata_album_album_name",
        uri="spotify_track_uri",
    ),
    "podcast": ClassFields(
        track="episode_name",
        track_default="Unknown Episode",
        artist="show_name",
        artist_default="Unknown Show",
        album="show_name",
        uri="spotify_episode_uri",
    ),
    "audiobook": ClassFields(
        track="chapter_name",
        track_default="Unknown Chapter",
        artist="book_name",
        artist_default="Unknown Book",
        album="book_name",
        uri="spotify_episode_uri",
    ),
    "video": ClassFields(
        track="video_name",
        track_default="Unknown Video",
        artist="channel_name",
        artist_default="Unknown Channel",
        album="channel_name",
        uri="spotify_video_uri",
    ),
}

# Plays column -> field shared by all classes.
COMMON_FIELDS = {
    "reason_start": "reason_start",
    "reason_end": "reason_end",
    "platform": "platform",
    "user_agent": "user_agent_decrypted",
    "ip_address": "ip_addr_decrypted",
    "country": "conn_country",
}
COMMON_FLAGS = ("skipped", "offline", "incognito_mode")

_FILES_SCHEMA = "file_source string, file_path string, text string"


def file_class(name: Column) -> Column:
    lowered, chain = F.lower(name), None
    for part, kind in FILE_CLASSES.items():
        test = lowered.contains(part)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("other")


def _or_empty(spark: SparkSession, load, path: str, schema: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"{path} does not exist", stacklevel=3)
        return spark.createDataFrame([], schema)


def discover_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``(file_source, file_path, length, content_type)`` of the export files in a
    directory, without reading their content; 'other' files are listed but never parsed.
    Spark does not show files of zero bytes, so they are neither listed nor rejected."""

    def load() -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        name = F.element_at(F.split("path", "/"), -1)
        listed = files.select(
            F.url_decode(name).alias("file_source"), F.col("path").alias("file_path"), "length"
        )
        return in_few_tasks(listed, files)

    schema = "file_source string, file_path string, length bigint"
    listed = _or_empty(spark, load, path, schema)
    return listed.withColumn("content_type", file_class(F.col("file_source")))


def read_history_texts(spark: SparkSession, path: str, at_most: int | None = None) -> DataFrame:
    """One row per ``*.json`` file with its whole text; ``at_most``: files of so many bytes."""

    def load() -> DataFrame:
        files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
        some = files if at_most is None else files.where(F.col("_metadata.file_size") <= at_most)
        texts = some.select(
            F.col("_metadata.file_name").alias("file_source"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("value").alias("text"),
        )
        return in_few_tasks(texts, files)

    return _or_empty(spark, load, path, _FILES_SCHEMA)


def _classified(files: DataFrame) -> DataFrame:
    kind = file_class(F.col("file_source"))
    return files.withColumn("content_type", kind).filter(F.col("content_type") != "other")


def file_elements(files: DataFrame) -> DataFrame:
    """One row per array element, and one with a ``reason`` for a file that cannot be read; a
    readable file that is no array contributes none."""
    read = _classified(files).select(
        "content_type", "file_source", "file_path", "text", F.from_json("text", "array<variant>").alias("items")
    )
    # Only what is no array is parsed again.
    broken = F.when(F.col("items").isNull(), F.try_parse_json("text").isNull())
    exploded = read.select(
        "content_type", "file_source", "file_path", broken.alias("broken"), F.posexplode_outer("items").alias("pos", "item")
    )
    return exploded.where("pos IS NOT NULL OR broken").select(
        F.xxhash64("file_path", "pos").alias("play_id"),
        "content_type",
        "file_source",
        "pos",
        "item",
        F.when(F.col("broken"), "unreadable file").alias("reason"),
        F.lit(None).cast("string").alias("line"),
    )


def _array_elements(spark: SparkSession, path: str, more_than: int) -> DataFrame:
    """The same of files of more than so many bytes, each read by many tasks.

    An element that cannot be read, or text around the array, costs no other element."""
    found = _classified(split_elements(spark, path, more_than))
    small = F.col("pos") <= 2**31 - 1
    play_id = F.when(small, F.xxhash64("file_path", F.col("pos").cast("int"))).otherwise(F.xxhash64("file_path", "pos"))
    item = F.when(F.col("pos").isNotNull(), F.try_parse_json("text"))
    reason = F.when(F.col("pos").isNull(), F.col("text")).when(F.col("item").isNull(), "unreadable element")
    return found.withColumn("item", item).select(
        play_id.alias("play_id"),
        "content_type",
        "file_source",
        "pos",
        "item",
        reason.alias("reason"),
        F.when(reason == "unreadable element", F.col("text")).alias("line"),
    )


#: Struct type of the times.  They are told apart from the other fields because filters ask this
#: struct whether an element is an object, and Spark works out a filter's columns twice.
TIMES_TYPE = "struct<ts: variant, offline_timestamp: variant>"


def _record_type() -> str:
    """Struct type of the other known fields, but for the uri, of which each class has one.

    Fields with a default stay VARIANT, where an absent key is null and an explicit null
    is a value; the rest are typed at once, and one that does not convert is null.
    """
    fields = {"ms_played": "variant"}
    fields |= {name: "boolean" for name in ("shuffle", *COMMON_FLAGS)}
    fields |= {name: "string" for name in COMMON_FIELDS.values()}
    for of in CLASS_FIELDS.values():
        fields |= {of.album: "string"}
    for of in CLASS_FIELDS.values():
        fields |= {of.track: "variant", of.artist: "variant"}
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in fields.items()) + ">"


RECORD_TYPE = _record_type()


def _text(field: str) -> str:
    """SQL for a field's text, typed or still VARIANT."""
    if f"{field}: variant" in RECORD_TYPE:
        return f"try_variant_get(r.{field}, '$', 'string')"
    return f"r.{field}"


def _by_class(text) -> str:
    steps = " ".join(f"WHEN '{kind}' THEN {text(of)}" for kind, of in CLASS_FIELDS.items())
    return f"CASE content_type {steps} END"


def parsed(elements: DataFrame, bad_ts_value: Column | None = None) -> DataFrame:
    """All elements, taken apart by casts to structs: typed plays plus ``ts_status``, and
    ``pos``, ``reason`` and ``content`` of those that are no play (null reason: a play).

    From rows ``(play_id, content_type, file_source, pos, item, reason, line)``.  A timestamp
    that is missing or unreadable becomes null, or ``bad_ts_value``.
    """

    def or_default(field: str, default: str) -> str:
        return f"IF(r.{field} IS NULL, '{default}', {_text(field)})"

    records = elements.select(
        "play_id", "content_type", "file_source", "pos", "item", "reason", "line",
        F.try_variant_get("item", "$", TIMES_TYPE).alias("t"),
        F.try_variant_get("item", "$", RECORD_TYPE).alias("r"),
    )
    timed = add_parsed_timestamp(records, "t.ts", "timestamp", "ts_status")
    timed = add_parsed_timestamp(timed, "t.offline_timestamp", "offline_timestamp", "__offline")
    if bad_ts_value is not None:
        timed = timed.withColumn("timestamp", F.coalesce("timestamp", bad_ts_value))
    columns = {
        "track_name": _by_class(lambda of: or_default(of.track, of.track_default)),
        "artist_name": _by_class(lambda of: or_default(of.artist, of.artist_default)),
        "album_name": _by_class(lambda of: _text(of.album)),
        "track_uri": _by_class(lambda of: f"try_variant_get(item, '$.{of.uri}', 'string')"),
        "ms_played": "IF(r.ms_played IS NULL, 0, try_variant_get(r.ms_played, '$', 'bigint'))",
        "shuffle": "IF(content_type = 'music', r.shuffle, NULL)",
        **{column: f"r.{field}" for column, field in COMMON_FIELDS.items()},
        **{flag: f"r.{flag}" for flag in COMMON_FLAGS},
    }
    reason = "coalesce(reason, IF(t IS NULL, 'element is not an object', NULL))"
    return timed.selectExpr(
        *[
            f"CAST({columns.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in PLAYS_SCHEMA
        ],
        "ts_status",
        "pos",
        f"{reason} AS reason",
        f"IF({reason} IS NULL, NULL, coalesce(line, to_json(item))) AS content",
    )


def plays_of(elements: DataFrame) -> DataFrame:
    """The plays among rows of `parsed`."""
    return elements.filter("reason IS NULL").drop("pos", "reason", "content")


def rejects_of(elements: DataFrame) -> DataFrame:
    """What of the rows of `parsed` is no play: ``(file_source, pos, reason, content)``."""
    return elements.filter("reason IS NOT NULL").select("file_source", "pos", "reason", "content")


def parse_history(files: DataFrame, bad_ts_value: Column | None = None) -> DataFrame:
    """Plays of all classes from rows ``(file_source, file_path, text)``, in one pass."""
    return plays_of(parsed(file_elements(files), bad_ts_value))


def rejected(files: DataFrame) -> DataFrame:
    """What could not be parsed: ``(file_source, pos, reason, content)``.

    An unreadable file is one reject without position; an element that is no object is
    one reject.  A readable file whose top level is no array has neither rows nor
    rejects.
    """
    return rejects_of(parsed(file_elements(files)))


def read_parsed(
    spark: SparkSession,
    path: str,
    bad_ts_value: Column | None = None,
    whole_bytes: int = WHOLE_BYTES,
    files: DataFrame | None = None,
) -> DataFrame:
    """`parsed` elements of a directory of exports.

    Files of more than ``whole_bytes`` are read by many tasks each, see `split_elements`: of an
    unreadable one, the readable elements stay, and what is no array at all is a reject.
    ``files``: what `discover_files` has found there, if it was asked before."""
    small = parsed(file_elements(read_history_texts(spark, path, whole_bytes)), bad_ts_value)
    small = small.withColumn("pos", F.col("pos").cast("long"))
    files = discover_files(spark, path) if files is None else files
    if files.where(F.col("length") > whole_bytes).isEmpty():
        return small
    return small.unionByName(parsed(_array_elements(spark, path, whole_bytes), bad_ts_value))


def read_history(
    spark: SparkSession, path: str, bad_ts_value: Column | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Plays from a directory of exports, of any size."""
    return plays_of(read_parsed(spark, path, bad_ts_value, whole_bytes))


def line_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-empty line of files with one JSON object per line; large files split
    over tasks.  An id is the hash of file and line, so it is the same on every reading;
    equal lines of a file share it, which sessions and joins bear."""
    lines = spark.read.text(path, pathGlobFilter="*.json*").filter("trim(value) != ''")
    classified = _classified(
        lines.select(
            F.col("_metadata.file_name").alias("file_source"),
            F.xxhash64(F.col("_metadata.file_path"), F.col("value")).alias("play_id"),
            F.col("value").alias("line"),
            F.try_parse_json("value").alias("item"),
        )
    )
    reason = F.when(F.col("item").isNull(), "unreadable line")
    return classified.withColumns({"pos": F.lit(None).cast("long"), "reason": reason})


def read_parsed_lines(
    spark: SparkSession, path: str, bad_ts_value: Column | None = None
) -> DataFrame:
    """`parsed` lines of a directory."""
    return parsed(line_elements(spark, path), bad_ts_value)


def read_history_lines(
    spark: SparkSession, path: str, bad_ts_value: Column | None = None
) -> DataFrame:
    """Plays from files with one JSON object per line; `rejected_lines` has the rest."""
    return plays_of(read_parsed_lines(spark, path, bad_ts_value))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no play, in the form of `rejected`."""
    return rejects_of(read_parsed_lines(spark, path))
