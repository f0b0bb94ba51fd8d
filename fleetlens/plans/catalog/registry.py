"""Imports every catalog module, so that its queries are registered."""

from fleetlens.plans.catalog import detections, fleet, health, rules, runs, streams, topics, windows  # noqa: F401
from fleetlens.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
