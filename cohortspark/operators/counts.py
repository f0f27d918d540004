"""Counts and shares per calendar interval, item filters and summary lines.

The raw rows are read once and reduced to counts before the first shuffle. What follows
works on the counts; where they are needed twice Spark reuses their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortspark.functions import (
    bucket,
    bucket_label,
    ceil_year,
    parse_datetime,
    quarter_grid,
    round_percent,
)
from cohortspark.operators.filters import quoted

VISIT_DATE = "Visit Date"


def with_interval(df: DataFrame, interval: str, ts: str = VISIT_DATE) -> DataFrame:
    """Add column ``interval`` with the start of the interval of each row."""
    when = quoted(ts)
    if isinstance(df.schema[ts].dataType, StringType):
        when = parse_datetime(when)
    return df.withColumn(interval, bucket(when, interval))


def with_label(chart: DataFrame, interval: str) -> DataFrame:
    """Add the axis text of each interval."""
    return chart.withColumn("label", bucket_label(quoted(interval), interval))


def interval_counts(
    df: DataFrame, factors: Sequence[str], interval: str, ts: str = VISIT_DATE
) -> DataFrame:
    """``factors, interval, total``: rows per combination. Missing values count as a group."""
    bucketed = with_interval(df, interval, ts)
    return bucketed.groupBy(*map(quoted, factors), quoted(interval)).agg(
        F.count(F.lit(1)).alias("total")
    )


def with_interval_total(counts: DataFrame, interval: str) -> DataFrame:
    """Add ``countT``, the total of the interval over all factor combinations.

    A join on the few interval totals instead of a window, which would bring all the
    combinations of an interval into one task.
    """
    whole = counts.groupBy(quoted(interval).alias("whole_interval")).agg(
        F.sum("total").alias("countT")
    )
    same = counts[f"`{interval}`"].eqNullSafe(whole.whole_interval)
    return counts.join(whole, same).drop("whole_interval")


def with_percentage(counts: DataFrame, interval: str) -> DataFrame:
    """Add ``countT`` and ``percentage``, the share of the interval's total."""
    shared = with_interval_total(counts, interval)
    return shared.withColumn("percentage", round_percent(F.col("total"), F.col("countT")))


def top_items(
    counts: DataFrame,
    by: Sequence[str],
    factors: Sequence[str],
    n: int = 5,
    y: str = "total",
    ascending: bool = False,
    mode: str = "parity",
) -> DataFrame:
    """At most ``n`` rows for each group of ``by``.

    ``mode="strict"`` takes the first ``n`` by ``y``, equal ones in factor order.
    ``mode="parity"`` takes every row whose ``y`` is at least the n-th best, and of these
    the first ``n`` in factor order; ties can so push out the leader.

    Each step ranks with a limit of ``n``, which Spark applies in every map task first, so
    a group of any size and with any number of ties stays small after the shuffle.
    """
    if n < 1:
        raise ValueError("n starts at 1")
    if mode not in ("parity", "strict"):
        raise ValueError(f"mode must be 'parity' or 'strict', not {mode!r}")
    groups = [quoted(name) for name in by]
    best_first = quoted(y).asc_nulls_last() if ascending else quoted(y).desc_nulls_last()
    in_factor_order = [quoted(name).asc_nulls_last() for name in factors]
    if mode == "strict":
        return _first_rows(counts, Window.partitionBy(*groups).orderBy(best_first, *in_factor_order), n)

    by_y = Window.partitionBy(*groups).orderBy(best_first)
    bound = F.max(y) if ascending else F.min(y)
    bounds = (
        _first_rows(counts.select(*groups, quoted(y)), by_y, n)
        .groupBy(*[group.alias(f"bound_{i}") for i, group in enumerate(groups)])
        .agg(bound.alias("bound"))
    )
    same_group = [
        counts[f"`{name}`"].eqNullSafe(bounds[f"bound_{i}"]) for i, name in enumerate(by)
    ]
    good = counts[y] <= bounds.bound if ascending else counts[y] >= bounds.bound
    match = reduce(lambda left, right: left & right, same_group, good)
    kept = counts.join(bounds, match, "left_semi")
    return _first_rows(kept, Window.partitionBy(*groups).orderBy(*in_factor_order), n)


def bottom_items(counts: DataFrame, by: Sequence[str], factors: Sequence[str], **options) -> DataFrame:
    """``top_items`` for the smallest values."""
    return top_items(counts, by, factors, ascending=True, **options)


def _first_rows(df: DataFrame, window: Window, n: int) -> DataFrame:
    numbered = df.withColumn("row_in_group", F.row_number().over(window))
    return numbered.where(F.col("row_in_group") <= n).drop("row_in_group")


# The second-level aggregates a line chart can show, by name. The values are totals or
# percentages of two decimals, so `median` keeps few distinct values whatever the row
# count: k distinct totals need at least k * (k + 1) / 2 rows.
SUMMARIES = {"sum": F.sum, "mean": F.avg, "sd": F.stddev_samp, "median": F.median}


def summary_line(
    chart: DataFrame,
    interval: str,
    func: str,
    y: str = "total",
    facet: str | None = None,
) -> DataFrame:
    """``interval [, facet], value``: one aggregate over the series of each interval."""
    if func not in SUMMARIES:
        raise ValueError(f"func must be one of {list(SUMMARIES)}, not {func!r}")
    keys = [quoted(interval)] + ([quoted(facet)] if facet else [])
    value = SUMMARIES[func](quoted(y)).cast("double")
    return chart.where(quoted(y).isNotNull()).groupBy(*keys).agg(value.alias("value"))


def interval_grid(df: DataFrame, ts: str = VISIT_DATE) -> DataFrame:
    """``tick``: quarter starts from the first year of the data to the end of its last."""
    quarters = with_interval(df, "Quarters", ts)
    ends = quarters.agg(F.min("Quarters").alias("first"), F.max("Quarters").alias("last"))
    first, last = bucket(F.col("first"), "Years"), ceil_year(F.col("last"))
    return ends.select(F.explode(quarter_grid(first, last)).alias("tick"))
