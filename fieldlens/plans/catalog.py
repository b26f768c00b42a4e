"""All core queries; importing this module registers them."""

from fieldlens.plans import format_queries, observation_queries, operator_queries, scalar_queries  # noqa: F401
from fieldlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
