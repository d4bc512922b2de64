"""Every operator as a query over the driver's tables, next to equivalent SQL."""

from checks import behavior_checks, explore_checks, ingest_checks  # noqa: F401
from checks import rollup_checks, row_checks, sink_checks  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
