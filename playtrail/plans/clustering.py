"""Session clusters: k-means whose outcome depends on the sessions alone.

Spark ML seeds its centres by partition and adds doubles in the order of partitions, so the
layout of the same rows shows in its result.  Here a session's chances come from a hash of its
key, and sums are exact (whole millionths), so any layout gives the same centres.  Every step
is one aggregate over the features, written once; the driver sees one row for each centre.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.params import DEFAULTS, PlayParams
from playtrail.session import materialize

# Cluster features and labels by cluster number.
CLUSTER_FEATURES = (
    "session_duration_minutes",
    "tracks_in_session",
    "skip_rate",
    "completion_rate",
)
CLUSTER_LABELS = ("Short Sessions", "Long Sessions", "High Skip Rate", "Engaged Listening")


def _feature_rows(sessions: DataFrame, params: PlayParams) -> DataFrame:
    """Features with nulls as 0."""
    keys = [*params.keys, "session_id"]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CLUSTER_FEATURES}
    return sessions.select(
        *{*keys, "content_type"}, *[column.alias(name) for name, column in filled.items()]
    )


#: Features are counted in millionths, so that sums are exact.
_UNIT = 1_000_000
_SCALED = [f"v{k}" for k in range(len(CLUSTER_FEATURES))]


@dataclass(frozen=True)
class Centres:
    """Centres in millionths, and the standard deviation of each feature (0: no weight)."""

    values: tuple[tuple[float, ...], ...]
    deviations: tuple[float, ...]

    def distances(self, columns: list[Column]) -> Column:
        """Squared distances from all centres, in standard deviations."""
        return F.array(*(self._distance(c, columns) for c in self.values))

    def _distance(self, centre: tuple[float, ...], columns: list[Column]) -> Column:
        total = F.lit(0.0)
        for column, value, deviation in zip(columns, centre, self.deviations):
            if deviation:
                total = total + F.pow((column - F.lit(value)) / F.lit(deviation), F.lit(2.0))
        return total

    def nearest(self, columns: list[Column]) -> Column:
        """Number of the nearest centre, the first of equally near ones."""
        distances = self.distances(columns)
        return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def _points(rows: DataFrame, params: PlayParams) -> DataFrame:
    """Features in millionths, and a hash of the session."""
    values = [F.round(F.col(c) * _UNIT).cast("long").alias(v) for c, v in zip(CLUSTER_FEATURES, _SCALED)]
    keys = [*params.keys, "session_id"]
    return rows.select(F.xxhash64(F.lit(params.seed), *keys).alias("h"), *values)


def _deviations(points: DataFrame) -> tuple[int, tuple[float, ...]]:
    """Number of points and standard deviation of each feature, from exact sums."""
    parts = []
    for v in _SCALED:
        exact = F.col(v).cast("decimal(18,0)")
        parts += [F.sum(exact).alias(f"{v}_sum"), F.sum(exact * exact).alias(f"{v}_square")]
    row = points.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    n = row["n"]
    if n < 2:
        return n, tuple(0.0 for _ in _SCALED)
    spreads = [int(row[f"{v}_square"]) * n - int(row[f"{v}_sum"]) ** 2 for v in _SCALED]
    return n, tuple(float((Decimal(s) / (n * (n - 1))).sqrt()) for s in spreads)


def seed_centres(points: DataFrame, deviations: tuple[float, ...], k: int) -> Centres:
    """Up to k different points: each is drawn with a chance in proportion to the squared
    distance from those before it, by the smallest of exponential variables made of hashes."""
    found = Centres((), deviations)
    columns = [F.col(v) for v in _SCALED]
    for step in range(k):
        uniform = (F.shiftrightunsigned(F.xxhash64("h", F.lit(step)), 11) + 0.5) / float(1 << 53)
        weight = F.array_min(found.distances(columns)) if found.values else F.lit(1.0)
        wait = F.when(weight > 0, -F.log(uniform) / weight)
        first = points.select(wait.alias("wait"), "h", *_SCALED).where("wait IS NOT NULL")
        row = first.agg(F.min(F.struct("wait", "h", *_SCALED)).alias("least")).first()["least"]
        if row is None:
            break
        found = Centres((*found.values, tuple(float(row[v]) for v in _SCALED)), deviations)
    return found


def train_centres(points: DataFrame, centres: Centres, rounds: int) -> Centres:
    """Lloyd's rounds from given centres, until they stay; a centre without points stays."""
    if not centres.values:
        return centres
    columns = [F.col(v) for v in _SCALED]
    for _ in range(rounds):
        sums = [F.sum(F.col(v).cast("decimal(18,0)")).alias(v) for v in _SCALED]
        by_centre = points.groupBy(centres.nearest(columns).alias("centre")).agg(F.count(F.lit(1)).alias("n"), *sums)
        values = list(centres.values)
        for row in by_centre.collect():  # one row a centre
            values[row["centre"]] = tuple(float(row[v] / row["n"]) for v in _SCALED)
        moved = Centres(tuple(values), centres.deviations)
        if moved == centres:
            break
        centres = moved
    return centres


def find_centres(sessions: DataFrame, params: PlayParams = DEFAULTS) -> Centres:
    """At most ``clusters`` centres; fewer where fewer different sessions are."""
    points = materialize(_points(_feature_rows(sessions, params), params), "cluster-points")
    _, deviations = _deviations(points)
    return train_centres(points, seed_centres(points, deviations, params.clusters), params.cluster_rounds)


def _numbers_by_meaning(centres: tuple[tuple[float, ...], ...]) -> list[int]:
    """Cluster number for every centre.

    k-means numbers its clusters arbitrarily.  Here the longest centre becomes 'Long
    Sessions', of the rest the one skipping most 'High Skip Rate', of the rest the one
    finishing most 'Engaged Listening', and what remains 'Short Sessions'.
    """
    left = set(range(len(centres)))
    numbers = [0] * len(centres)
    for number, feature in ((1, 0), (2, 2), (3, 3)):
        if len(left) > 1:
            chosen = max(left, key=lambda c: (centres[c][feature], -c))
            numbers[chosen] = number
            left.remove(chosen)
    return numbers


def cluster_sessions(sessions: DataFrame, params: PlayParams = DEFAULTS) -> DataFrame:
    """All sessions with ``cluster`` and ``cluster_type``.

    There are as many centres as ``clusters``, or as there are different sessions if these
    are fewer.  The features are written once and read in each round.
    """
    rows = _feature_rows(sessions, params)
    centres = find_centres(sessions, params)
    if not centres.values:  # no sessions
        return rows.withColumns({"cluster": F.lit(0), "cluster_type": F.lit(CLUSTER_LABELS[0])})
    numbers = F.array(*[F.lit(n) for n in _numbers_by_meaning(centres.values)])
    labels = F.array(*[F.lit(label) for label in CLUSTER_LABELS])
    centre = centres.nearest([F.round(F.col(c) * _UNIT) for c in CLUSTER_FEATURES])
    return rows.withColumn("cluster", F.get(numbers, centre)).withColumn("cluster_type", F.get(labels, F.col("cluster")))


def cluster_analysis(clustered: DataFrame) -> DataFrame:
    """Mean features and most frequent content type of each cluster."""
    return clustered.groupBy("cluster", "cluster_type").agg(
        *[F.avg(c).alias(c) for c in CLUSTER_FEATURES],
        F.mode("content_type", deterministic=True).alias("content_type"),
    )


def cluster_distribution(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
