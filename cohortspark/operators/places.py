"""Counts by place, for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.filters import quoted

# The columns a map can show.
LEVELS = ("State", "District")


def check_level(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"a map works with one of {list(LEVELS)}, not {level!r}")


def place_counts(df: DataFrame, level: str) -> DataFrame:
    """``place, total``; rows without a place are left out."""
    check_level(level)
    known = df.where(quoted(level).isNotNull())
    return known.groupBy(quoted(level).alias("place")).agg(F.count(F.lit(1)).alias("total"))


def busiest_place(counts: DataFrame) -> DataFrame:
    """The row with the greatest count; of equal ones, the first by name."""
    return counts.orderBy(F.desc("total"), F.asc("place")).limit(1)
