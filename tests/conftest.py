import os
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendcloud import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bars_of(spark):
    """Bar table from {ticker: [(open, high, low, close, volume), ...]} on consecutive days."""

    def build(series, start=date(2024, 1, 1)):
        rows = [
            (ticker, start + timedelta(days=i), *bar)
            for ticker, bars in series.items()
            for i, bar in enumerate(bars)
        ]
        return spark.createDataFrame(rows, schema.BARS)

    return build
