"""Versions of an output folder: all tables of a stage appear at once, or none does.

A stage writes into a new folder below ``versions``.  When everything is there, an empty file
below ``published`` names that folder; creating it is one step in any store.  Readers take the
newest published version, so a stage that is killed half way leaves the former one in place,
and what it had written is never seen.  Numbers order versions; of two stages that publish the
same number, one is the newest for all readers alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_VERSIONS, _PUBLISHED = "versions", "published"


def _files(spark: SparkSession, path: str):
    """Path and file system of a folder, wherever it is stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(folder))


def published(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions, oldest first."""
    return _names(spark, f"{root}/{_PUBLISHED}")


def current(spark: SparkSession, root: str) -> str:
    """The folder of the newest published version; ``root`` itself if it has no versions."""
    names = published(spark, root)
    if names:
        return f"{root}/{_VERSIONS}/{names[-1]}"
    if _names(spark, f"{root}/{_VERSIONS}"):
        raise FileNotFoundError(f"{root} has versions, but none is complete")
    return root


@contextmanager
def new_version(spark: SparkSession, root: str) -> Iterator[str]:
    """A folder to write to, which is published when the block ends without an error."""
    known = published(spark, root)
    number = int(known[-1].split("-")[0]) + 1 if known else 1
    name = f"{number:08d}-{uuid.uuid4().hex}"
    yield f"{root}/{_VERSIONS}/{name}"
    marker, files = _files(spark, f"{root}/{_PUBLISHED}/{name}")
    if not files.createNewFile(marker):
        raise FileExistsError(f"{root}: version {name} is published already")


def remove_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all versions but the newest published ones, and what was never published.

    Not for use while a stage writes or a job reads an older version."""
    names = published(spark, root)
    kept = set(names[-keep:]) if keep else set()
    gone = [n for n in _names(spark, f"{root}/{_VERSIONS}") if n not in kept]
    for name in gone:
        for part in (_PUBLISHED, _VERSIONS):  # first out of sight, then out of the store
            folder, files = _files(spark, f"{root}/{part}/{name}")
            files.delete(folder, True)
    return gone
