"""Named queries over the driver tables, with their SQL oracles."""

from gaugewright.plans import catalog, network, sensors, streams, verdicts  # noqa: F401  the modules register their queries
from gaugewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
