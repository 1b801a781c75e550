"""Query-log and metric-usage analytics on Spark."""

from metricledger.params import PageRequest, TimeRange

__all__ = ["PageRequest", "TimeRange"]
