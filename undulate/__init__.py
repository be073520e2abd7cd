"""Trace, voxel, event and cohort analytics as Spark DataFrame plans."""

from undulate.session import build_session

__all__ = ["build_session"]
