"""Name → Spark callable, name → equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "rolling_q", "signal_q", "select_q", "aggregate_q", "pairs_q", "events_q", "spectral_q", "cohort_q", "voxels_q",
    "matching_q", "ml_q", "reports_q", "sources_q",
]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"undulate.plans.{m}")


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with −0 folded into 0, as both engines print it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def i8(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
