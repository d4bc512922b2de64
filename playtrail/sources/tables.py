"""Reading back what the sinks wrote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from playtrail.schema import PARSED_SCHEMA
from playtrail.sinks.layout import ENRICHED, SUMMARY
from playtrail.sinks.versions import current


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    """Parsed plays, to re-enter at enrichment."""
    return spark.read.schema(PARSED_SCHEMA).parquet(path)


@dataclass
class EnrichedData:
    plays: DataFrame | None
    rollups: dict[str, DataFrame] = field(default_factory=dict)
    summary: DataFrame | None = None


# A table written from no rows has no file to take a schema from.
_ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def _if_there(read, path: str) -> DataFrame | None:
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() not in _ABSENT:
            raise
        return None


def table_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the ``*.parquet`` tables directly under a directory, from its own listing:
    what lies deeper, such as the files of the plays, is not visited."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    return _if_there(spark.read.json, f"{path}/{SUMMARY}")


def load_enriched(spark: SparkSession, path: str) -> EnrichedData:
    """Enriched plays, every other table next to them by name, and the summary.

    Without enriched plays everything is empty; other absent parts just stay out.  Of a
    folder with versions, the newest complete one is read.
    """
    path = current(spark, path)
    plays = _if_there(spark.read.parquet, f"{path}/{ENRICHED}")
    if plays is None:
        return EnrichedData(None)
    others = [n for n in table_names(spark, path) if f"{n}.parquet" != ENRICHED]
    found = {name: _if_there(spark.read.parquet, f"{path}/{name}.parquet") for name in others}
    tables = {name: table for name, table in found.items() if table is not None}
    return EnrichedData(plays, tables, read_summary(spark, path))
