"""The one group-by every rollup is built from, over plays or over a play cube.

A *cube* is an intermediate rollup holding additive parts (sums and counts) at a grain
fine enough for many results, so a pipeline reads the plays once, writes the cube, and
computes all additive results from it.  The play cube's size depends on the calendar and
the category domains only; the name cube grows with the albums heard per day.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.binning import derive
from playtrail.functions.temporal import calendar_columns, clock_columns
from playtrail.operators.grid import densify
from playtrail.schema import AUDIO_MEANS

EFFICIENCY = "listening_efficiency"
# A part that only cubes have; plays may well carry a column of counts.
_CUBE_MARK = f"{EFFICIENCY}__n"

PLAY_CUBE_KEYS = ("date", "hour", "content_type", "platform_category", "mood")
CLASS_CUBE_KEYS = ("year", "time_of_day", "content_type", "platform_category", "mood")
NAME_CUBE_KEYS = ("date", "content_type", "artist_name", "album_name")


# Count-like measures over plays; a cube holds them under the same names and sums them up.
MEASURES = {
    "n_rows": "count(1)",
    "ms_played": "coalesce(sum(ms_played), 0)",
    "plays": "count(track_name)",
    "skips": "count_if(is_skip)",
    "completes": "count_if(is_complete_listen)",
}


def _parts(mean_columns: Sequence[str], measures: Iterable[str] = MEASURES) -> list[Column]:
    texts = [f"{MEASURES[name]} AS {name}" for name in measures]
    texts += [f"sum({c}) AS {c}__sum" for c in mean_columns]
    texts += [f"count({c}) AS {c}__n" for c in mean_columns]
    return [F.expr(text) for text in texts]


def play_cube(plays: DataFrame) -> DataFrame:
    """Additive parts per hour, content type, platform category and mood."""
    cube = plays.groupBy(*PLAY_CUBE_KEYS).agg(*_parts([*AUDIO_MEANS, EFFICIENCY]))
    return derive(cube, {**calendar_columns("date"), **clock_columns("hour")})


def name_cube(plays: DataFrame) -> DataFrame:
    """Additive parts per day, content type, artist and album."""
    cube = plays.groupBy(*NAME_CUBE_KEYS).agg(*_parts([*AUDIO_MEANS, EFFICIENCY]))
    return derive(cube, calendar_columns("date"))


def class_cube(cube: DataFrame) -> DataFrame:
    """The play cube without its days, a few hundred rows a year at most, for results that ask for
    years and classes only."""
    parts = [*MEASURES, *[f"{c}__{part}" for c in (*AUDIO_MEANS, EFFICIENCY) for part in ("sum", "n")]]
    return cube.groupBy(*CLASS_CUBE_KEYS).agg(*[F.sum(name).alias(name) for name in parts])


def is_cube(df: DataFrame) -> bool:
    return _CUBE_MARK in df.columns


def measure(df: DataFrame, name: str) -> Column:
    """Aggregate expression of a count-like measure, for plays or a cube."""
    text = f"coalesce(sum({name}), 0)" if is_cube(df) else MEASURES[name]
    return F.expr(f"{text} AS {name}")


def mean(df: DataFrame, column: str) -> Column:
    """Aggregate expression of a mean, for plays or a cube."""
    from_parts = f"try_divide(sum({column}__sum), CAST(sum({column}__n) AS DOUBLE))"
    return F.expr(f"{from_parts if is_cube(df) else f'avg({column})'} AS {column}")


def count_distinct(name: str, columns: str | tuple[str, ...]) -> Column:
    return F.countDistinct(*([columns] if isinstance(columns, str) else columns)).alias(name)


def rollup(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] = ("ms_played", "plays"),
    means: Sequence[str] = (),
    distinct: dict[str, str | tuple[str, ...]] | None = None,
    dense: str | None = None,
) -> DataFrame:
    """Group plays or a cube, then add hours and rates.

    Rows with a null key are left out.  ``distinct`` maps output name to the column(s)
    whose distinct values are counted (exactly; Spark dedupes map-side, then by value,
    so one large group is spread over tasks; several columns are counted on distinct
    combinations, not on plays).  ``dense`` names the ordered category
    among the keys whose empty cells are to be reported.
    """
    distinct = distinct or {}
    if len(distinct) > 1 and not is_cube(df):
        df = _cells(df, keys, measures, means, distinct.values())
    cells = (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            *[measure(df, m) for m in measures],
            *[mean(df, c) for c in means],
            *[count_distinct(name, columns) for name, columns in distinct.items()],
        )
    )
    if dense:
        others = [k for k in keys if k != dense]
        cells = densify(cells, dense, others, zero=[*measures, *distinct])
    return add_rates(cells)


def _cells(
    plays: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    means: Sequence[str],
    distinct: Iterable[str | tuple[str, ...]],
) -> DataFrame:
    """A cube just for one rollup: counting several columns' distinct values multiplies its
    input, so that had better be distinct combinations than plays."""
    counted = [c for d in distinct for c in ([d] if isinstance(d, str) else d)]
    grain = list(dict.fromkeys([*keys, *counted]))
    parts = _parts(means, measures)
    mark = [] if EFFICIENCY in means else [F.count(F.lit(1)).alias(_CUBE_MARK)]
    return plays.dropna(subset=list(keys)).groupBy(*grain).agg(*parts, *mark)


def add_rates(df: DataFrame) -> DataFrame:
    present, extra = set(df.columns), {}
    if "ms_played" in present:
        extra["listening_hours"] = "ms_played / 3600000"
    if "skips" in present:
        extra["skip_rate"] = "try_divide(CAST(skips AS DOUBLE), CAST(plays AS DOUBLE))"
    if "completes" in present:
        extra["completion_rate"] = "try_divide(CAST(completes AS DOUBLE), CAST(plays AS DOUBLE))"
    return derive(df, extra) if extra else df


def totals(
    df: DataFrame,
    measures: Sequence[str] = (),
    means: Sequence[str] = (),
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """One row over everything."""
    return df.agg(
        *[measure(df, m) for m in measures],
        *[mean(df, c) for c in means],
        *[count_distinct(name, columns) for name, columns in (distinct or {}).items()],
    )
