"""All registered graph queries and their SQL."""

from __future__ import annotations

from .queries import derived, drilldown, files, iterative, lookups, relational  # noqa: F401  they register themselves
from .queries.base import ORACLES, QUERIES

FLAGSHIP = "O-fixedpoint"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
