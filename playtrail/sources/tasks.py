"""How many tasks read a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes that a task reads, where there are more files or ranges than tasks are wanted.
TASK_BYTES = 64 << 20


def in_few_tasks(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """``rows`` made of a ``scan`` without a shuffle, many files or ranges to a task, in their order.

    Spark counts 4 MB for a file however small it is, and a task for each range, so a folder
    of many small files has tasks that start longer than they run.  Of all tasks there are
    four for each core, and as many as the bytes of the files want."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(4 * cores, -(-size // TASK_BYTES)))
