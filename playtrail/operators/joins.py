"""Left joins that stay balanced when many left rows have no key, and the feature join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "__spread"


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    row_id: str = "play_id",
    null_safe: Sequence[str] = (),
) -> DataFrame:
    """Left equi-join on ``on`` in which unmatched-by-definition rows do not pile up.

    Columns in ``null_safe`` match null with null; of the others a null cannot match, yet
    a shuffled left join sends all such rows to one task.  A second key, the hash of the
    row id for those rows and constant for all others, spreads them out and leaves every
    real match as it was.  Hot non-null keys are split by adaptive execution's skew-join
    handling, which `prepare` switches on.  No broadcast hint: Spark broadcasts the right
    side on its own when its size is known and small.
    """
    strict = [name for name in on if name not in null_safe]
    keyless = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in strict], F.lit(False))
    spread = F.when(keyless, F.xxhash64(row_id)).otherwise(F.lit(0).cast("long"))
    other = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    matches = [
        F.col(c).eqNullSafe(F.col(f"__{c}")) if c in null_safe else F.col(c) == F.col(f"__{c}")
        for c in on
    ]
    condition = reduce(lambda a, b: a & b, matches, F.col(_SPREAD) == F.col("__right_spread"))
    return (
        left.withColumn(_SPREAD, spread)
        .join(other.withColumn("__right_spread", F.lit(0).cast("long")), condition, "left")
        .drop(_SPREAD, "__right_spread", *[f"__{c}" for c in on])
    )


def join_audio_features(plays: DataFrame, features: DataFrame) -> DataFrame:
    """Attach audio features by ``track_uri = track_id``.

    Every play is kept, repeated track ids fan out, and feature columns that clash
    with a play column get the suffix ``_audio``.  If either side lacks its key the
    plays come back unchanged.  A null uri matches nothing.
    """
    if "track_uri" not in plays.columns or "track_id" not in features.columns:
        return plays
    clashing = set(plays.columns) & set(features.columns)
    renamed = features.select(
        F.col("track_id").alias("track_uri"),
        *[F.col(c).alias(f"{c}_audio" if c in clashing else c) for c in features.columns],
    )
    joined = spread_left_join(plays, renamed, ["track_uri"])
    return joined.select(*plays.columns, *renamed.columns[1:])


def feature_coverage(joined: DataFrame) -> DataFrame:
    """Row count after the join and how many rows found features."""
    key = "track_id_audio" if "track_id_audio" in joined.columns else "track_id"
    return joined.agg(F.count(F.lit(1)).alias("records"), F.count(key).alias("with_features"))
