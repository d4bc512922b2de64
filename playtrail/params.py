"""Every tunable of the library in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PlayParams:
    """Analysis thresholds.  Durations are milliseconds unless named otherwise."""

    # Analysis defaults.
    session_timeout_ms: int = 1_800_000
    min_listening_ms: int = 30_000
    skip_threshold: float = 0.3
    fallback_skip_ms: int = 30_000
    fallback_track_ms: int = 180_000
    binge_minutes: float = 60.0
    clusters: int = 4
    seed: int = 42

    # Columns that split plays into independent timelines.  ("user_id",
    # "content_type") turns the single-listener model into a multi-user one.
    keys: tuple[str, ...] = ("content_type",)

    # Rank accuracy of the sketch behind exact medians: about 4/accuracy of the
    # rows of a group survive into the final ranking step.
    median_accuracy: int = 100_000

    # Rounds of k-means after which centres that still move are taken as they are.
    cluster_rounds: int = 100

    @property
    def session_key(self) -> tuple[str, ...]:
        """What tells sessions of one content type apart."""
        return (*[k for k in self.keys if k != "content_type"], "session_id")

    @property
    def session_timeout_us(self) -> int:
        return self.session_timeout_ms * 1000


DEFAULTS = PlayParams()
