"""All registered queries."""

from tidemark.plans import learning, models, projections, series  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
