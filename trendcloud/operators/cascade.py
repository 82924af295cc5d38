"""Choosing one source per series by priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendcloud.sources.files import ensure_checkpoint_dir, present_tickers, read_series

# The sources from first to last choice, with their labels.
LABELS = {
    "s3_cache": "AWS S3 cache",
    "s3_csv": "AWS S3 CSV",
    "local_csv": "local CSV backup",
    "yahoo_finance": "Yahoo Finance",
}


def source_label(source: Column) -> Column:
    """Display label of a source; unknown ones stand for themselves."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(labels[source], source)


def gate_sources(
    snapshot: DataFrame,
    stored: DataFrame,
    local: DataFrame,
    provider: DataFrame,
    use_csv: bool = False,
    use_s3: bool = False,
    use_cache: bool = True,
    local_ticker: str | None = None,
) -> list[tuple[str, DataFrame, bool]]:
    """The four sources in order, each with whether a request may use it.

    With `local_ticker` the local source serves that ticker alone.
    """
    if local_ticker is not None:
        local = local.filter(F.col("ticker") == local_ticker)
    return [
        ("s3_cache", snapshot, use_s3 and use_cache),
        ("s3_csv", stored, use_s3),
        ("local_csv", local, use_csv),
        ("yahoo_finance", provider, True),
    ]


def resolve_sources(
    sources: Sequence[tuple[str, DataFrame, bool]], present: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """For each series the rows of the first source that has any, plus `source`, `label`.

    `present` gives, for sources whose tickers are known from a catalogue or from
    folders, a DataFrame with the column `ticker`; for the others it is read from
    the rows. Sources that are switched off are not in the plan at all. The tickers
    that each source serves are settled on names alone, one small row per ticker and
    source; a source's rows are read once and meet the tickers it serves in a semi
    join, the last source's those served already in an anti join, so nothing is
    asked of it beforehand. A text stands for a missing ticker, so all joins are
    plain ones.
    """
    enabled = [(name, df) for name, df, on in sources if on]
    if not enabled:
        raise ValueError("no source is enabled")
    present = present or {}
    series = F.coalesce(F.col("ticker"), F.lit("\x00")).alias("_series")
    *earlier, last = enabled
    parts = []
    if earlier:
        names = [
            present.get(name, df).select(series).withColumn("_rank", F.lit(rank))
            for rank, (name, df) in enumerate(earlier)
        ]
        offered = reduce(DataFrame.unionByName, names)
        first = offered.groupBy("_series").agg(F.min("_rank").alias("_first"))
    for rank, (name, df) in enumerate(enabled):
        rows = df.withColumns({"_series": series, "source": F.lit(name)})
        if earlier and name != last[0]:
            rows = rows.join(first.filter(F.col("_first") == rank), "_series", "left_semi")
        elif earlier:
            # Always true, but with it the names are the same plan in every join, and run once.
            rows = rows.join(first.filter(F.col("_first") >= 0), "_series", "left_anti")
        parts.append(rows)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.drop("_series").withColumn("label", source_label(F.col("source")))


@dataclass(frozen=True)
class StoredSource:
    """A table of `write_bars`, or one day of a snapshot table, that is read as far as it serves."""

    name: str
    path: str
    ticker: str | None = None  # the one that it serves, if it is for one alone

    @staticmethod
    def of_day(name: str, path: str, day: date) -> StoredSource:
        return StoredSource(name, f"{path.rstrip('/')}/cache_date={day.isoformat()}")

    def tickers(self, spark: SparkSession) -> DataFrame:
        names = present_tickers(spark, self.path)
        return names if self.ticker is None else names.filter(F.col("ticker") == self.ticker)


def resolve_stored(
    spark: SparkSession, sources: Sequence[StoredSource], provider: DataFrame | None = None
) -> DataFrame:
    """For each series the rows of the first source that has it, plus `source`, `label`.

    The sources' presence indexes, a few small files each, settle which one serves a
    ticker. Of each source only the buckets with tickers that it serves are listed
    and opened, and none if earlier ones serve them all. A `provider` comes last and
    gives what no stored source has. Series that have expired from a snapshot but lie
    in its files yet must be compacted before. Runs jobs when called.
    """
    series = F.coalesce(F.col("ticker"), F.lit("\x00")).alias("_series")
    parts = []
    if sources:
        ensure_checkpoint_dir(spark)
        names = [s.tickers(spark).select(series, "bucket", F.lit(rank).alias("_rank")) for rank, s in enumerate(sources)]
        offered = reduce(DataFrame.unionByName, names)
        first = offered.groupBy("_series").agg(F.min(F.struct("_rank", "bucket")).alias("_first")).select("_series", "_first.*").checkpoint()
        needed = first.select("_rank", "bucket").distinct().collect()  # at most sources x buckets
        for rank, source in enumerate(sources):
            buckets = [r["bucket"] for r in needed if r["_rank"] == rank]
            if buckets:
                rows = read_series(spark, source.path, buckets=buckets).withColumns({"_series": series, "source": F.lit(source.name)})
                parts.append(rows.join(first.filter(F.col("_rank") == rank).select("_series"), "_series", "left_semi"))
    if provider is not None:
        rows = provider.withColumns({"_series": series, "source": F.lit("yahoo_finance")})
        parts.append(rows.join(first.select("_series"), "_series", "left_anti") if sources else rows)
    if not parts:
        raise ValueError("no source has a series")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.drop("_series").withColumn("label", source_label(F.col("source")))
