"""Ticker names: validation and existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendcloud.functions.columns import WHITE_SPACE, join_keys, strip

# Refused names and the reasons given.
BLACKLIST = ("TEST", "SPAM", "HACK", "NULL", "ADMIN", "DELETE", "DROP", "EXEC")
NOT_A_STRING = "Ticker must be a non-empty string"
BAD_LENGTH = "Ticker must be 1-5 characters long"
BAD_CHARACTERS = "Ticker must contain only letters and numbers"

def clean_ticker(name: Column) -> Column:
    """Upper case without white space at either end (any kind, not only blanks)."""
    return strip(F.upper(name))


def is_ticker(name: Column) -> Column:
    """Whether a name is accepted.

    One pattern on the name as it is: filters on it move down to the scan, where
    an expression of several steps would be worked out again for each step.
    """
    space = f"[{WHITE_SPACE}]*"
    pattern = f"^{space}(?!(?:{'|'.join(BLACKLIST)}){space}$)[A-Z0-9]{{1,5}}{space}$"
    return F.coalesce(F.upper(name).rlike(pattern), F.lit(False))


def refusal(name: Column) -> Column:
    """Why a name is refused; NULL for one that is accepted."""
    clean = clean_ticker(name)
    return (
        F.when(is_ticker(name), F.lit(None).cast("string"))
        .when(name.isNull() | (name == ""), F.lit(NOT_A_STRING))
        .when(~F.length(clean).between(1, 5), F.lit(BAD_LENGTH))
        .when(clean.isin(*BLACKLIST), F.concat(F.lit("Ticker '"), clean, F.lit("' is not allowed")))
        .otherwise(F.lit(BAD_CHARACTERS))
    )


def validate_tickers(df: DataFrame, col: str = "ticker") -> DataFrame:
    """Add the cleaned `symbol` (NULL if refused), `is_valid` and `reason`."""
    name = F.col(col)
    accepted = is_ticker(name)
    return df.withColumns(
        {
            "symbol": F.when(accepted, clean_ticker(name)),
            "is_valid": accepted,
            "reason": refusal(name),
        }
    )


def ticker_exists(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mark the requested tickers that the catalogue holds."""
    known = catalog.select("ticker").distinct().withColumn("_known", F.lit(True))
    joined = join_keys(requested, known, ["ticker"], "left")
    return joined.select(*requested.columns, F.col("_known").isNotNull().alias("exists"))
