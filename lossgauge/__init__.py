"""Indicator and loss analytics on Spark DataFrames."""

from lossgauge.session import build_session

__all__ = ["build_session"]
