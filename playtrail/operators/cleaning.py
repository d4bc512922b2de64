"""Filling gaps before features are derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.binning import derive
from playtrail.operators.medians import column_medians
from playtrail.params import DEFAULTS, PlayParams
from playtrail.schema import AUDIO_CODES, AUDIO_MEASURES

# Stand-ins for missing entries.
NAME_FILLS = {
    "track_name": "Unknown Track",
    "artist_name": "Unknown Artist",
    "album_name": "Unknown Album",
}
CATEGORY_FILLS = {c: "Unknown" for c in ("platform", "user_agent", "ip_address", "country")}
FLAG_FILLS = {c: False for c in ("shuffle", "skipped", "offline", "incognito_mode")}
CODE_FILLS = {c: -1 for c in AUDIO_CODES}

_MEDIANS = "__medians"


def fill_constants(plays: DataFrame) -> DataFrame:
    """Names, categories, flags and audio codes get their fixed stand-ins."""
    fills = {**NAME_FILLS, **CATEGORY_FILLS, **FLAG_FILLS, **CODE_FILLS}
    return plays.na.fill({c: v for c, v in fills.items() if c in plays.columns})


def fill_medians(
    plays: DataFrame, params: PlayParams = DEFAULTS, medians: DataFrame | None = None
) -> DataFrame:
    """Audio measures get the exact median of their column; an all-null column stays null.

    ``medians`` (rows ``feature, median``) can be handed in when already known.  They
    reach the rows as one scalar map of at most ten entries.
    """
    present = [c for c in AUDIO_MEASURES if c in plays.columns]
    if not present:
        return plays
    if medians is None:
        medians = column_medians(plays, present, params.median_accuracy)
    lookup = medians.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "median")))
    ).scalar()
    # One column holding the map, so that the subquery is planned once.
    filled = {c: f"coalesce(nanvl(CAST({c} AS DOUBLE), NULL), {_MEDIANS}['{c}'])" for c in present}
    return derive(plays.withColumn(_MEDIANS, lookup), filled).drop(_MEDIANS)


def fill_missing(
    plays: DataFrame, params: PlayParams = DEFAULTS, medians: DataFrame | None = None
) -> DataFrame:
    return fill_medians(fill_constants(plays), params, medians)
