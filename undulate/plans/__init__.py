"""Runnable queries over the canonical inputs, each with its SQL statement where one exists."""

from undulate.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
