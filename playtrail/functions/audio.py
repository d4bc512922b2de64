"""Columns derived from audio features: mood, levels, tempo name, complexity, genre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.binning import bin_ordinal, derive, level_name
from playtrail.schema import (
    AUDIO_DEFAULTED,
    INTENSITY,
    INTENSITY_EDGES,
    TEMPO_EDGES,
    TEMPO_NAMES,
)

# Fixed value: stands in for a feature the table has no column for.
NEUTRAL_FEATURE = 0.5

# Quadrants of the valence/energy plane.
MOOD = """
CASE WHEN valence >= 0.5D AND energy >= 0.5D THEN 'Happy'
     WHEN valence >= 0.5D AND energy < 0.5D THEN 'Calm'
     WHEN valence < 0.5D AND energy >= 0.5D THEN 'Energetic'
     WHEN valence < 0.5D AND energy < 0.5D THEN 'Sad'
     ELSE 'Neutral' END
"""

# Ordered genre rules, first match wins.
GENRE = """
CASE WHEN danceability > 0.7D AND energy > 0.7D THEN 'Pop/Dance'
     WHEN acousticness > 0.7D AND instrumentalness < 0.3D THEN 'Folk/Acoustic'
     WHEN instrumentalness > 0.7D THEN 'Instrumental'
     WHEN speechiness > 0.5D THEN 'Hip-Hop/Rap'
     WHEN energy > 0.8D AND tempo > 140D THEN 'Electronic'
     WHEN valence < 0.3D AND energy < 0.5D THEN 'Sad/Emo'
     ELSE 'Other' END
"""

# Feature weights.
COMPLEXITY = (
    "instrumentalness * 0.3D + speechiness * 0.2D + (1 - acousticness) * 0.3D + liveness * 0.2D"
)


def add_default_features(plays: DataFrame) -> DataFrame:
    """Give absent feature *columns* a neutral constant; present ones stay as they are."""
    present = set(plays.columns)
    absent = [name for name in AUDIO_DEFAULTED if name not in present]
    return derive(plays, {name: f"{NEUTRAL_FEATURE}D" for name in absent}) if absent else plays


def add_audio_features(plays: DataFrame, tempos: DataFrame | None = None) -> DataFrame:
    """Derive the audio columns.

    ``tempo_category`` is 'Unknown' for every row only if no row has a tempo.  That
    one bit comes from a scalar subquery whose tasks stop at their first hit, and is
    only asked for when tempo is a real column.  ``tempos`` is a cheaper frame to ask,
    if the caller has one with the same tempos.
    """
    tempo = bin_ordinal("tempo", TEMPO_EDGES)
    energy = bin_ordinal("energy", INTENSITY_EDGES)
    dance = bin_ordinal("danceability", INTENSITY_EDGES)
    out = derive(
        add_default_features(plays),
        {
            "mood": MOOD,
            "energy_level_ord": energy,
            "energy_level": level_name(energy, INTENSITY),
            "danceability_level_ord": dance,
            "danceability_level": level_name(dance, INTENSITY),
            "tempo_category_ord": tempo,
            "tempo_category": level_name(tempo, TEMPO_NAMES),
            "musical_complexity": COMPLEXITY,
            "inferred_genre": GENRE,
        },
    )
    if "tempo" not in plays.columns:
        return out
    known = (plays if tempos is None else tempos).select("tempo").filter("tempo IS NOT NULL").limit(1)
    nothing_known = known.agg(F.count("tempo")).scalar() == 0
    return out.withColumn(
        "tempo_category", F.when(nothing_known, "Unknown").otherwise(F.col("tempo_category"))
    )
