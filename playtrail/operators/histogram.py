"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int = 30, weight: str | None = None) -> DataFrame:
    """Rows ``(bin, bin_start, bin_end, n)`` for the non-empty bins of ``value``.

    Bins split [min, max] evenly, the maximum falls into the last bin, and a constant
    column lands in bin 1.  ``weight`` counts a row that many times.  The two bounds
    come from a scalar subquery.
    """
    rows = df.select(
        F.col(value).cast("double").alias("x"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w"),
    ).filter("x IS NOT NULL AND NOT isnan(x)")
    span = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    spread = rows.withColumn("span", span).selectExpr("x", "w", "span.lo AS lo", "span.hi AS hi")
    number = f"""
        CASE WHEN hi = lo THEN 1
             ELSE least(CAST(floor(try_divide(x - lo, hi - lo) * {bins}) AS INT) + 1, {bins}) END
    """
    return (
        spread.groupBy(F.expr(number).alias("bin"), "lo", "hi")
        .agg(F.sum("w").alias("n"))
        .selectExpr(
            "bin",
            f"lo + (hi - lo) / {bins} * (bin - 1) AS bin_start",
            f"lo + (hi - lo) / {bins} * bin AS bin_end",
            "n",
        )
    )
