"""Spark-native analytics for grouped, ordered event logs."""

from loomlog.session import build_session

__all__ = ["build_session"]
