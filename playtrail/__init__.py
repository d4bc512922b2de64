"""Play-history analytics as Spark DataFrame transformations."""

from playtrail.params import DEFAULTS, PlayParams

__all__ = ["DEFAULTS", "PlayParams"]
