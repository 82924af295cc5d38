"""Trend-indicator analytics on Spark DataFrames.

Everything takes and returns DataFrames; nothing here runs an action except the
sinks and the jobs that say so.
"""

from trendcloud.params import CloudParams
from trendcloud.operators.indicators import ichimoku_cloud

__all__ = ["CloudParams", "ichimoku_cloud"]
