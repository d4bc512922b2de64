"""Pairs of a Spark query and the SQL that must give the same rows on DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playtrail.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Queries with DATE columns.  Clients render dates differently (date, datetime64), so both
# sides show them as midnight timestamps.
DATED = {
    "temporal_features": ("date",),
    "temporal_features_events": ("date",),
    "derived_metrics": ("date",),
    "daily_stats": ("date",),
    "daily_stats_from_cube": ("date",),
    "daily_pattern_stats": ("date",),
    "daily_hours": ("date",),
    "filter_plays": ("date",),
    "filter_options": ("min_date", "max_date"),
    "sink_enriched_plays": ("date",),
    "sink_enriched_filtered": ("date",),
    "sink_results": ("date",),
    "pipeline_run": ("date",),
}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is only run and counted."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive(query(prepare(spark), sf_dir))

        QUERIES[name] = run
        if name in DATED:
            shown = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in DATED[name])
            ORACLES[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})"
        elif sql is not None:
            ORACLES[name] = sql
        return query

    return register


def naive(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as DuckDB has them, and dates at midnight."""
    dtypes = df.dtypes
    if not {"timestamp", "date"} & {t for _, t in dtypes}:
        return df
    return df.selectExpr(
        *[
            f"CAST(`{n}` AS TIMESTAMP_NTZ) AS `{n}`" if t in ("timestamp", "date") else f"`{n}`"
            for n, t in dtypes
        ]
    )


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Means of floats depend on summation order in the last digits."""
    return df.selectExpr(
        *[f"round(`{c}`, {digits}) AS `{c}`" if c in columns else f"`{c}`" for c in df.columns]
    )


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name}"


def hours(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE) / 3600000 AS listening_hours"


def rate(part: str, whole: str, name: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif({whole}, 0) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"
