"""Registered queries and their SQL."""

from skyloom.plans import feeds, relational, sky  # noqa: F401  (they register)
from skyloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
