"""Exact medians that never gather a whole group in one task.

``percentile`` keeps every distinct value of a group in one buffer.  Here a sketch
first brackets the median, a second pass counts distinct values inside the bracket
(everything outside collapses to two counters before the shuffle), and only the
bracket is ranked.  The ranks are checked, so the answer is exact or the job fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtrail.params import DEFAULTS
from playtrail.schema import CLOSED_DOMAINS


def _clean(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    accuracy: int = DEFAULTS.median_accuracy,
) -> DataFrame:
    """One row per key with the exact median (mean of the two middle values).

    The keys must come from closed domains, whose number of values does not grow with the
    data: the brackets of all groups are one value, and the values inside a group's bracket
    are ranked by one task.
    """
    if not set(keys) <= CLOSED_DOMAINS:
        raise ValueError(f"median keys must be among {sorted(CLOSED_DOMAINS)}")
    found = column_medians(df, [value], accuracy, keys)
    return found.select(*keys, F.col("median").alias(name))


def column_medians(
    df: DataFrame,
    columns: Sequence[str],
    accuracy: int = DEFAULTS.median_accuracy,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact median of several columns at once: rows ``(*keys, feature, median)``.

    The rows are read twice: one aggregate has the sketches of all columns, a second one counts
    their values inside a bracket and what lies below it.
    """
    keys = list(keys)
    values = [f"__v{i}" for i in range(len(columns))]
    rows = df.select(*keys, *[_clean(F.col(c)).alias(v) for c, v in zip(columns, values)])
    margin = 2.0 / accuracy
    sketches = F.struct(
        *[F.percentile_approx(v, [0.5 - margin, 0.5 + margin], accuracy).alias(v) for v in values]
    )
    if keys:
        # One scalar map of all groups' brackets: no row moves to learn its own.
        rows = rows.dropna(subset=keys)
        group = F.concat_ws("\0", *keys)
        brackets = rows.groupBy(group.alias("__g")).agg(sketches.alias("__b"))
        by_group = brackets.agg(F.map_from_entries(F.collect_list(F.struct("__g", "__b")))).scalar()
        bounded = rows.withColumn("__all", by_group).withColumn("__b", F.col("__all")[group]).drop("__all")
    else:
        bounded = rows.withColumn("__b", rows.agg(sketches).scalar())

    # One pass: rows that agree in what lies inside the brackets, of most rows nothing, are counted
    # together with what lies below, so that only these few groups are taken apart by column.
    bracket = [F.expr(f"IF({v} BETWEEN __b.{v}[0] AND __b.{v}[1], {v}, NULL)").alias(f"in{v}") for v in values]
    counts = [f"count({v}) AS n{v}, count_if({v} < __b.{v}[0]) AS below{v}" for v in values]
    folded = bounded.groupBy(*keys, *bracket).agg(*[F.expr(e) for text in counts for e in text.split(", ")])
    names = [f"'{c}', in{v}, n{v}, below{v}" for c, v in zip(columns, values)]
    by_value = folded.selectExpr(*keys, f"stack({len(columns)}, {', '.join(names)}) AS (feature, v, n, below)")
    by_value = by_value.groupBy(*keys, "feature", "v").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    group = W.partitionBy(*keys, "feature")
    upto = group.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = by_value.select(
        *keys,
        "feature",
        "v",
        "n",
        F.sum("n").over(group).alias("total"),
        F.sum("below").over(group).alias("below"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).over(upto).alias("inside"),
    ).where("v IS NOT NULL")

    def at_rank(rank: str) -> Column:
        hit = F.expr(f"below + inside - n < {rank} AND below + inside >= {rank}")
        miss = F.raise_error(F.lit("median fell outside its bracket; lower the accuracy"))
        return F.coalesce(F.max(F.when(hit, F.col("v"))), miss.cast("double"))

    median = (at_rank("(total + 1) div 2") + at_rank("total div 2 + 1")) / 2
    return ranked.groupBy(*keys, "feature").agg(median.alias("median"))
