"""The named queries."""

from stormlift.plans import decide, explore, features, learn, metrics, stream  # noqa: F401  (they register themselves)
from stormlift.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
