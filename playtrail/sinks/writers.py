"""Parquet, JSON, CSV and text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.sinks.layout import ENRICHED, INSIGHTS, PARSED, STATISTICS, SUMMARY

#: Order of the rows in a file of the enriched table, below the year.
CLUSTERED = ("date", "content_type", "artist_name")
_BLOOM = {
    "parquet.bloom.filter.enabled#artist_name": "true",
    # As large as the distinct names of a row group want, of several sizes tried.
    "parquet.bloom.filter.adaptive.enabled": "true",
}
#: Spark writes milliseconds unless told otherwise.
_STAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_plays(plays: DataFrame, path: str) -> str:
    """Parsed plays, one directory per content type."""
    target = f"{path}/{PARSED}"
    plays.hint("rebalance").write.mode("overwrite").partitionBy("content_type").parquet(target)
    return target


def write_enriched(enriched: DataFrame, path: str) -> str:
    """Enriched plays, one directory per year, laid out for filters on days and artists.

    The rebalance hint groups rows by month, splits months that are too large for one file
    and merges those that are too small.  In a file rows are sorted by day and class, so the
    statistics of its row groups and pages tell days apart; a Bloom filter tells artists.
    """
    target = f"{path}/{ENRICHED}"
    months = enriched.hint("rebalance", "year", "month").sortWithinPartitions("year", *CLUSTERED)
    months.write.mode("overwrite").options(**_BLOOM).partitionBy("year").parquet(target)
    return target


def write_table(table: DataFrame, path: str, name: str) -> str:
    target = f"{path}/{name}.parquet"
    table.write.mode("overwrite").parquet(target)
    return target


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    return {name: write_table(table, path, name) for name, table in tables.items()}


def write_summary(summary: DataFrame, path: str) -> str:
    """The one-row summary document."""
    target = f"{path}/{SUMMARY}"
    summary.write.mode("overwrite").options(**_STAMPS).json(target)
    return target


def write_statistics(statistics: DataFrame, path: str) -> str:
    """The one-row parse statistics."""
    target = f"{path}/{STATISTICS}"
    statistics.write.mode("overwrite").options(**_STAMPS).json(target)
    return target


def write_results(results: dict[str, dict[str, DataFrame]], path: str) -> None:
    """Every table of every analysis as ``{analysis}_results.json/{table}``, machine readable."""
    for analysis, tables in results.items():
        for name, table in tables.items():
            table.write.mode("overwrite").options(**_STAMPS).json(f"{path}/{analysis}_results.json/{name}")


def write_insights(insights: DataFrame, path: str) -> str:
    target = f"{path}/{INSIGHTS}"
    insights.coalesce(1).write.mode("overwrite").options(**_STAMPS).json(target)
    return target


def write_csv(plays: DataFrame, path: str) -> None:
    """Filtered plays for download, as one or more files with a header each."""
    plays.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """The report lines in order; a few dozen rows, hence one file."""
    lines = report.coalesce(1).sortWithinPartitions("section_ord", "ord")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
