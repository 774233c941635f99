"""Imports every module that registers queries."""

from workload import (  # noqa: F401
    aggregates, composites, indexed, joins, projections, scalars, searches, sinks, sorts, sources, streams,
)
