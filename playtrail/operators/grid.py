"""Group-by over ordered categories that reports empty cells too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.schema import SEASONS, TIME_OF_DAY

LEVELS = {"time_of_day": TIME_OF_DAY, "season": SEASONS}


def densify(
    cells: DataFrame, level: str, others: Sequence[str], zero: Sequence[str]
) -> DataFrame:
    """Complete an aggregate on ``(level, *others)`` to all levels x observed others.

    ``cells`` has at most one row per level and other key, so packing them into a map
    per other key holds a handful of entries; the fixed level list is then exploded
    against that map.  No join and no second look at the data.  Columns in ``zero``
    become 0 in empty cells, the rest stay null.
    """
    measures = [c for c in cells.columns if c not in (level, *others)]
    packed = (
        cells.filter(F.col(level).isNotNull())
        .groupBy(*others)
        .agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(level), F.struct(*measures)))).alias(
                "cells"
            )
        )
    )
    levels = F.array(*[F.lit(name) for name in LEVELS[level]])
    dense = packed.select(
        *others, "cells", F.posexplode(levels).alias(f"{level}_ord", level)
    ).withColumn("cell", F.try_element_at("cells", F.col(level)))
    picked = [
        F.coalesce(F.col("cell")[m], F.lit(0)).alias(m) if m in zero else F.col("cell")[m].alias(m)
        for m in measures
    ]
    return dense.select(level, f"{level}_ord", *others, *picked)
