"""Anomaly detection over large collections of time series, as PySpark jobs."""

from tidewatch.session import configure, release

__all__ = ["configure", "release"]
