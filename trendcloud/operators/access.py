"""The access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTION = "data_access"


def access_records(
    attempts: DataFrame, at: Column, ticker: Column, source_ip: Column, success: Column
) -> DataFrame:
    """Attempts as records of the access log."""
    return attempts.select(
        at.alias("timestamp"),
        ticker.alias("ticker"),
        source_ip.alias("source_ip"),
        F.coalesce(success, F.lit(True)).alias("success"),
        F.lit(ACTION).alias("action"),
    )


def access_log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("ticker", "action").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
