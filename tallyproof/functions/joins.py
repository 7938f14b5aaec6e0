"""Join helpers: broadcast behind a row check, and salted joins for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; looks at no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only for a side counted to be small; beyond it Spark joins by shuffle with skew splitting."""
    return F.broadcast(df) if small(df, rows) else df


def salted_join(big: DataFrame, other: DataFrame, on: list[str], salts: int = 32, how: str = "inner") -> DataFrame:
    """Equi-join where one key may hold a large part of ``big``: its rows are spread over ``salts`` and the rows of
    ``other`` are repeated for each salt. ``other`` should be the side with few rows per key."""
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    o = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(o, on + ["_salt"], how).drop("_salt")
