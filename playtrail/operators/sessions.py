"""Gap-based sessions without sorting the plays.

Cut every timeline into slots as long as the session timeout.  Two plays in one slot
are closer than the timeout, so **a slot never spans a session break**; breaks only
fall between neighbouring non-empty slots, where the gap is the next slot's first play
minus the previous slot's last.  That turns sessionising into

1. one ``groupBy(keys, slot)`` with map-side combine: a hot key or a hot half hour
   shrinks to one row per task before the shuffle;
2. one window over the slots of a key: at most (time span / timeout) rows, however
   many plays there are;
3. if the plays themselves need the id, one equi-join on ``(keys, slot)``.

Session-level results need only steps 1 and 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from playtrail.functions.nulls import minutes, truthy
from playtrail.operators.joins import spread_left_join
from playtrail.params import DEFAULTS, PlayParams

SLOT = "session_slot"
_SECOND_US = 1_000_000
_CURRENT = (W.unboundedPreceding, W.currentRow)


def slot_start(ts: Column, width_us: int) -> Column:
    """Start of the fixed-width slot holding ``ts``, as epoch microseconds."""
    us = F.unix_micros(ts)
    return us - F.pmod(us, F.lit(width_us))


def session_slots(
    plays: DataFrame, params: PlayParams = DEFAULTS, measures: dict[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, slot): first and last instant, additive measures, session id.

    ``measures`` are additive aggregates over plays to carry along.  Plays without a
    timestamp belong to no session.
    """
    keys = list(params.keys)
    ts = F.col("timestamp")
    slots = (
        plays.filter(ts.isNotNull())
        .groupBy(*keys, slot_start(ts, params.session_timeout_us).alias(SLOT))
        .agg(
            F.min(F.unix_micros(ts)).alias("first_us"),
            F.max(F.unix_micros(ts)).alias("last_us"),
            *[m.alias(name) for name, m in (measures or {}).items()],
        )
    )
    timeline = W.partitionBy(*keys).orderBy(SLOT)
    gap = F.col("first_us") - F.col("previous_us")
    opens = F.col("previous_us").isNull() | (gap > params.session_timeout_us)
    return slots.withColumn("previous_us", F.lag("last_us").over(timeline)).withColumn(
        "session_id", F.sum(F.when(opens, 1).otherwise(0)).over(timeline.rowsBetween(*_CURRENT))
    )


def session_index(plays: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    """(keys, slot) -> session id and the statistics of that session.

    Small (bounded by keys x time span / timeout).  Write it out once and hand it to
    `attach_sessions` when several results need it.
    """
    keys = list(params.keys)
    slots = session_slots(
        plays,
        params,
        {"ms": F.sum("ms_played"), "tracks": F.count("track_name")},
    )
    session = W.partitionBy(*keys, "session_id")
    total_ms = F.coalesce(F.sum("ms").over(session), F.lit(0))
    return slots.select(
        *keys,
        SLOT,
        "previous_us",
        "session_id",
        total_ms.alias("session_duration"),
        F.sum("tracks").over(session).alias("tracks_in_session"),
        F.timestamp_micros(F.min("first_us").over(session)).alias("session_start"),
        F.timestamp_micros(F.max("last_us").over(session)).alias("session_end"),
        minutes(total_ms).alias("session_duration_minutes"),
    )


def attach_sessions(
    plays: DataFrame, params: PlayParams = DEFAULTS, index: DataFrame | None = None
) -> DataFrame:
    """Session id and session statistics on every play."""
    if index is None:
        index = session_index(plays, params)
    slotted = plays.withColumn(SLOT, slot_start(F.col("timestamp"), params.session_timeout_us))
    found = index.drop("previous_us")
    joined = spread_left_join(slotted, found, [*params.keys, SLOT], null_safe=params.keys)
    added = [c for c in index.columns if c not in (*params.keys, SLOT, "previous_us")]
    return joined.select(*plays.columns, *added)


def instant_gaps(plays: DataFrame, params: PlayParams, index: DataFrame) -> DataFrame:
    """``(keys, us, play_id, gap_us)``: one row per instant, for the play that opens it.

    Needs the true predecessor of each play, which a window per key would find by
    sorting a whole timeline in one task.  Instead, plays collapse to distinct instants
    (all but one play of an instant have gap 0), instants are ordered inside one-second
    cells (at most a million instants), cells inside slots, and slots inside keys.
    """
    keys = list(params.keys)
    cell = F.col("us") - F.pmod(F.col("us"), F.lit(_SECOND_US))
    slot = F.col("us") - F.pmod(F.col("us"), F.lit(params.session_timeout_us))
    instants = plays.groupBy(*keys, "us").agg(F.min("play_id").alias("play_id"))
    instants = instants.withColumns({SLOT: slot, "cell": cell})

    in_slot = W.partitionBy(*keys, SLOT).orderBy("cell")
    cells = (
        instants.groupBy(*keys, SLOT, "cell")
        .agg(F.max("us").alias("last_us"))
        .withColumn("before_us", F.lag("last_us").over(in_slot))
    )
    slots = index.select(*keys, SLOT, "previous_us")
    cells = spread_left_join(cells, slots, [*keys, SLOT], "cell", null_safe=keys).select(
        *keys, SLOT, "cell", F.coalesce("before_us", "previous_us").alias("before_us")
    )
    in_cell = W.partitionBy(*keys, SLOT, "cell").orderBy("us")
    ordered = instants.withColumn("last_us", F.lag("us").over(in_cell))
    placed = spread_left_join(ordered, cells, [*keys, SLOT, "cell"], null_safe=keys)
    return placed.select(
        *keys, "us", "play_id", (F.col("us") - F.coalesce("last_us", "before_us")).alias("gap_us")
    )


def _never_null(df: DataFrame, columns: Sequence[str]) -> tuple[list[Column], list[str]]:
    """For each column its value, of some kind where it is null, and whether it is null."""
    out, names = [], []
    for k, name in enumerate(columns):
        value, kind = F.col(name), df.schema[name].dataType
        plain = value if isinstance(kind, NumericType) else value.cast("string")
        filled = F.coalesce(plain, F.lit(0).cast(kind) if isinstance(kind, NumericType) else F.lit(""))
        out += [filled.alias(f"__same{k}"), value.isNull().alias(f"__null{k}")]
        names += [f"__same{k}", f"__null{k}"]
    return out, names


def add_session_features(
    plays: DataFrame, params: PlayParams = DEFAULTS, index: DataFrame | None = None
) -> DataFrame:
    """Gaps, session ids and session statistics on every play.

    Everything is worked out on the distinct (keys, instant, play_id) and reaches the
    wide rows by one join on these.  Rows that agree in all three (fan-out of the feature
    join, repeated ids) are numbered where the join has put them: the first one opens
    the instant, the others follow it without a gap.  A null key is a key of its own.
    """
    keys = list(params.keys)
    if index is None:
        index = session_index(plays, params)
    ts = F.col("timestamp")
    narrow = plays.filter(ts.isNotNull()).select(*keys, F.unix_micros(ts).alias("us"), "play_id")
    gaps = instant_gaps(narrow, params, index).withColumn("opens_instant", F.lit(True))
    slot = F.col("us") - F.pmod(F.col("us"), F.lit(params.session_timeout_us))
    placed = narrow.distinct().withColumn(SLOT, slot)
    found = index.drop("previous_us")
    placed = spread_left_join(placed, found, [*keys, SLOT], null_safe=keys).drop(SLOT)
    placed = spread_left_join(
        placed, gaps, [*keys, "us", "play_id"], null_safe=[*keys, "play_id"]
    )
    # Keys that may be null, as pairs of columns that are not: equal rows meet in the join, and
    # stay together for numbering.  A row without instant gets a number of its own instead.
    same = [*keys, "play_id"]
    own, names = _never_null(plays, same)
    us = F.coalesce(F.unix_micros(ts), F.monotonically_increasing_id()).alias("__us")
    wide = plays.select("*", *own, us, ts.isNull().alias("__untimed"))
    added = [c for c in found.columns if c not in (*keys, SLOT)]
    narrow_side = placed.select(
        *_never_null(placed, same)[0],
        F.col("us").alias("__us"),
        F.lit(False).alias("__untimed"),
        "opens_instant",
        "gap_us",
        *added,
    )
    on = [*names, "__us", "__untimed"]
    joined = wide.join(narrow_side, on, "left")
    twin = F.row_number().over(W.partitionBy(*on).orderBy(F.lit(0)))
    opens = truthy(F.col("opens_instant")) & (F.col("__twin") == 1)
    gap_us = F.when(opens, F.col("gap_us")).when(ts.isNotNull(), F.lit(0))
    out = joined.withColumn("__twin", twin).withColumn("gap_us", gap_us)
    return out.select(
        *plays.columns,
        (F.col("gap_us") / F.lit(1000.0)).alias("time_since_last"),
        (F.col("gap_us").isNull() | (F.col("gap_us") > params.session_timeout_us)).alias(
            "new_session"
        ),
        *added,
    )


def attach_gaps(
    plays: DataFrame, params: PlayParams = DEFAULTS, index: DataFrame | None = None
) -> DataFrame:
    """``time_since_last`` (ms) and ``new_session`` on every play."""
    both = add_session_features(plays, params, index)
    return both.select(*plays.columns, "time_since_last", "new_session")
