"""Registered queries, each with the SQL that gives the same result."""

from rowferry.plans import (  # noqa: F401
    changes,
    dumps,
    filters,
    introspection,
    ledgers,
    payloads,
    projections,
    scans,
    watches,
    writes,
)
from rowferry.plans.registry import ORACLES, QUERIES  # noqa: F401
