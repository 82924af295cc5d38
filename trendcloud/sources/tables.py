"""The given tables seen as the inputs of the operators.

The tables hold orders, parts and events; the operators want daily bars, object
listings, logs and so on. Each function here is a plain query over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendcloud.operators.access import access_records
from trendcloud.schema import BAR_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines to one bar per value of `keys` and shipping day.

    Open and close are the prices of the first and last line by (order key,
    price). The two make one decimal, wide enough for any BIGINT key and prices
    below 10^13 to six places, as buffers that are plain numbers let the aggregation
    hash (and combine before the shuffle) where a struct would make it sort. Rows
    that tie have the same price, so the result is the same on every run.
    """
    price = F.col("l_extendedprice")
    order = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**13).cast("decimal(14,0)")
    return (
        lines.select(
            *keys,
            F.col("l_shipdate").cast("date").alias("time"),
            price.alias("price"),
            (order + price.cast("decimal(19,6)")).alias("place"),
        )
        .groupBy(*keys, "time")
        .agg(
            F.min_by("price", "place").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "place").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey)


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few long series: one per brand."""
    return _daily(brand_lines(spark, sf_dir), "p_brand").withColumnRenamed("p_brand", "ticker")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many shorter series: one per supplier."""
    bars = _daily(table(spark, sf_dir, "lineitem"), "l_suppkey")
    ticker = F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker")
    return bars.select(ticker, *BAR_NAMES)


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with series files, dated and undated snapshots and the registry.

    Per brand: one series file per year, one snapshot per shipping day, one
    undated snapshot per return flag. The lines are read and counted once, by
    brand, day and flag; only those counts are grouped in four ways.
    """
    counted = (
        brand_lines(spark, sf_dir)
        .groupBy("p_brand", "l_shipdate", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select(
            F.replace("p_brand", F.lit("#"), F.lit("")).alias("symbol"),
            F.col("l_shipdate").cast("date").alias("day"),
            F.year("l_shipdate").alias("year"),
            F.col("l_returnflag").alias("flag"),
            "lines",
            "l_shipdate",
        )
    )
    grouped = counted.groupingSets(
        [["symbol", "day"], ["symbol", "year"], ["symbol", "flag"], []],
        "symbol",
        "day",
        "year",
        "flag",
    ).agg(
        F.grouping_id().alias("grouping"),
        F.sum("lines").alias("lines"),
        F.max("l_shipdate").alias("last_modified"),
    )
    grouping = F.col("grouping")

    def named(prefix: str, column: str, suffix: str) -> Column:
        value = F.col(column).cast("string")
        return F.concat(F.lit(prefix), F.col("symbol"), F.lit("_"), value, F.lit(suffix))

    # Bits of the grouping number, from the left: symbol, day, year, flag; 1 = not grouped by.
    key = (
        F.when(grouping == 0b0011, named("cache/", "day", ".json"))
        .when(grouping == 0b0101, named("data/", "year", "_data.csv"))
        .when(grouping == 0b0110, named("cache/", "flag", ".json"))
        .otherwise(F.lit("data/available_tickers.txt"))
    )
    return grouped.select(key.alias("key"), (F.col("lines") * 64).alias("size"), "last_modified")


def snapshot_envelopes(spark: SparkSession, sf_dir: str, yearly: bool = False) -> DataFrame:
    """Per brand and month, or year, a snapshot holding its bars (31, or 366, at most).

    It is dated on the last day; those with an odd number of lines were stamped a
    day late.
    """
    bar = F.struct(F.col("time").cast("string").alias("time"), *BAR_NAMES[1:])
    last = F.make_date(F.year("time"), F.lit(12), F.lit(31)) if yearly else F.last_day("time")
    monthly = (
        brand_bars(spark, sf_dir)
        .groupBy("ticker", last.alias("cache_date"))
        .agg(F.collect_list(bar).alias("data"), F.sum("volume").alias("lines"))
    )
    stamped = F.date_add("cache_date", (F.col("lines") % 2).cast("int"))
    return monthly.select(
        "ticker",
        "cache_date",
        F.concat(stamped.cast("string"), F.lit("T10:00:00")).alias("timestamp"),
        "data",
        F.size("data").cast("bigint").alias("count"),
    )


def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry text: a line per part of size 50, with blanks about and empty lines between."""
    large = F.col("p_size") == 50
    name = F.concat(F.lit(" B"), F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)), F.lit("\t"))
    line = F.when(large, name).otherwise(F.lit(" "))
    return table(spark, sf_dir, "part").select(line.alias("value"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a provider's frame: capitalised columns, days as text, some unreadable."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'-05:00'")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(day).alias("Date"),
        F.col("l_extendedprice").alias("Open"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan")))
        .otherwise(F.col("l_extendedprice"))
        .alias("High"),
        F.col("l_quantity").alias("Low"),
        F.col("l_extendedprice").alias("Close"),
        F.col("l_linenumber").alias("Volume"),
    )


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as collected: untidy ticker names, and invalid ones for large parts."""
    number = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))
    untidy = F.concat(F.lit(" b"), number, F.lit("\n"))
    name = F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(untidy)
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("ticker"))
    lineitem = table(spark, sf_dir, "lineitem")
    bars = _daily(lineitem.join(part, lineitem.l_partkey == part.p_partkey), "ticker")
    return bars.withColumn("time", F.col("time").cast("string"))


def ticker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names people might type, one per customer."""
    key, name = F.col("c_custkey"), F.col("c_name")
    digits = F.substring(name, -4, 4)
    kind = key % 10
    typed = (
        F.when(kind == 0, F.concat(F.lit(" \t"), F.lower(F.col("c_mktsegment")), F.lit("\n")))
        .when(kind == 1, F.concat(F.lit("a"), digits))
        .when(kind == 2, F.concat(F.lit("A@"), F.substring(name, -2, 2)))
        .when(kind == 3, F.lit("test "))
        .when(kind == 4, F.lit("   "))
        .when(kind == 5, F.lit(""))
        .when(kind == 6, F.lit("delete"))
        .when(kind == 7, F.concat(F.lit("x"), F.substring(name, -3, 3), F.lit("  ")))
        .when(kind == 8, F.lit("drop"))
    )
    return table(spark, sf_dir, "customer").select(key, typed.alias("ticker"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: an `error` is one that failed."""
    user = F.col("user_id")
    upper, lower = F.floor(user / 256).cast("string"), (user % 256).cast("string")
    ip = F.concat_ws(".", F.lit("10.0"), upper, lower)
    return access_records(
        table(spark, sf_dir, "events"),
        F.col("ts"),
        F.upper("event_type"),
        ip,
        F.col("event_type") != "error",
    )
