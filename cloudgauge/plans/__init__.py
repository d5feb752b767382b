"""All registered queries."""

from cloudgauge.plans import aggregates, cloudplans, joins, models, rendering, rows, scans, testplans  # noqa: F401
from cloudgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
