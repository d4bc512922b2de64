"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text.removesuffix("T00:00:00")
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return repr(value + 0.0)
    return value


def canonical(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda row: tuple(map(repr, row)))


TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a description."""
    relation = con.execute(sql)
    types = {d[0]: str(d[1]) for d in relation.description}
    want_columns, want = canonical(list(types), relation.fetchall())
    got_columns, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    odd = {n: (t, types[n]) for n, t in spark_df.dtypes if TYPES.get(t, t) != types[n]}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        cells = [(c, g, w) for c, g, w in zip(got_columns, *bad[0]) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, first: {cells}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from checks import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                problem, note = None, f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - begin:6.2f}s  {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
