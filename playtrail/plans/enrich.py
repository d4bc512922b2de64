"""From plays to the enriched table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playtrail.functions.audio import add_audio_features
from playtrail.functions.behavior import add_behavior_features, add_content_flags
from playtrail.functions.temporal import add_temporal_features
from playtrail.operators.cleaning import fill_constants, fill_missing
from playtrail.operators.joins import join_audio_features
from playtrail.operators.medians import column_medians
from playtrail.operators.sessions import add_session_features, attach_sessions
from playtrail.params import DEFAULTS, PlayParams
from playtrail.schema import AUDIO_MEASURES


def add_row_features(
    plays: DataFrame, params: PlayParams = DEFAULTS, tempos: DataFrame | None = None
) -> DataFrame:
    """Every derived column that depends on its own row only: no shuffle."""
    timed = add_behavior_features(add_temporal_features(plays), params)
    return add_content_flags(add_audio_features(timed, tempos))


def create_derived_metrics(
    plays: DataFrame,
    params: PlayParams = DEFAULTS,
    index: DataFrame | None = None,
    gaps: bool = True,
    tempos: DataFrame | None = None,
) -> DataFrame:
    """All derived columns.  ``gaps=False`` leaves out ``time_since_last`` and
    ``new_session``, the only two that need each play's predecessor.  ``tempos`` is
    passed on to `add_audio_features`."""
    attach = add_session_features if gaps else attach_sessions
    return add_row_features(attach(plays, params, index), params, plays if tempos is None else tempos)


def enrich(
    plays: DataFrame,
    features: DataFrame | None = None,
    params: PlayParams = DEFAULTS,
    gaps: bool = True,
    unique_features: bool = False,
) -> DataFrame:
    """Join features (if given), fill what is missing, derive.

    Promise ``unique_features`` when no track id repeats: the join then keeps the number
    of plays, so sessions are found on the narrow plays before it, and what concerns the
    features only is asked of a join of two columns.  A broken promise raises an error.
    """
    if features is not None and unique_features and "track_id" in features.columns:
        ids = features.filter("track_id IS NOT NULL").groupBy("track_id").count()
        if not ids.filter("count > 1").isEmpty():
            raise ValueError("unique_features was promised, but track ids repeat")
    if features is None or not unique_features:
        if features is not None:
            plays = join_audio_features(plays, features)
        filled = fill_missing(plays, params)
        return create_derived_metrics(filled, params, gaps=gaps, tempos=plays)
    attach = add_session_features if gaps else attach_sessions
    placed = attach(fill_constants(plays), params)
    matched = join_audio_features(plays.select("play_id", "track_uri"), features)
    measures = [c for c in AUDIO_MEASURES if c in features.columns]
    medians = column_medians(matched, measures, params.median_accuracy)
    filled = fill_missing(join_audio_features(placed, features), params, medians)
    return add_row_features(filled, params, tempos=matched)
