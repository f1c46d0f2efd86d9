"""Importing this registers every query of the engine."""

from simigraph.plans import exact, matching, scalar, state, visual
from simigraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "exact", "matching", "scalar", "state", "visual"]
