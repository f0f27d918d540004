"""Pages of a sorted table: by place, and by the last row seen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.filters import quoted
from cohortspark.session import materialize

IN_RANGE_BITS = 33  # of Spark's increasing ids: the upper bits are the partition, the lower the row in it


def total_order(df: DataFrame, order_by: Sequence[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """``order_by``, then every other column ascending, so that only equal rows are tied."""
    named = [name for name, _ in order_by]
    return [*order_by, *[(name, True) for name in df.columns if name not in named]]


def sort_keys(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [quoted(name).asc() if up else quoted(name).desc() for name, up in order]


class SortedPages:
    """A table sorted once, whose pages are then read one by one.

    Rows are dealt out by ranges of the sort keys, sorted within their range and written with
    their place. Only the number of rows of each range comes to the driver: it tells in which ranges a
    page lies, and at which places. A page reads those places only, whatever its number.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[tuple[str, bool]] = ()):
        self.order = total_order(df, order_by)
        self.columns = df.columns
        self.place = "place"
        while self.place in df.columns:
            self.place += "_"
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(ranges, *sort_keys(self.order)).sortWithinPartitions(*sort_keys(self.order))
        self.rows = materialize(ranged.withColumn(self.place, F.monotonically_increasing_id()), "sorted")
        number = F.shiftright(self.place, IN_RANGE_BITS).alias("number")
        counts = self.rows.groupBy(number).agg(F.count(F.lit(1)).alias("n")).orderBy("number")
        self.ranges = [(row.number, row.n) for row in counts.collect()]

    def page(self, page: int, size: int) -> DataFrame:
        """Rows (page - 1) * size + 1 to page * size; fewer or none at the end of the table."""
        first = (page - 1) * size
        places, before = [], 0
        for number, n in self.ranges:
            low, high = max(first - before, 0), min(first + size - before, n)
            if low < high:
                start = number << IN_RANGE_BITS
                places.append(F.col(self.place).between(start + low, start + high - 1))
            before += n
        held = reduce(Column.__or__, places, F.lit(False))
        return self.rows.where(held).orderBy(self.place).select(*map(quoted, self.columns))


def page_after(
    df: DataFrame, last: Mapping[str, object], size: int, order_by: Sequence[tuple[str, bool]] = (), shown: int = 1
) -> DataFrame:
    """The ``size`` rows that follow the row ``last``, whose values are given by column.

    ``shown`` is how many rows equal to ``last`` were shown already. No place is counted: earlier rows
    are filtered out, in the scan where it can, and the least ``size`` of the others are kept.
    """
    order = total_order(df, order_by)
    missing = [name for name, _ in order if name not in last]
    if missing:
        raise ValueError(f"the last row has no {', '.join(missing)}")
    reached, so_far = F.lit(False), F.lit(True)
    for name, up in order:
        value, seen = quoted(name), last[name]
        if up:  # missing values come first
            later = value.isNotNull() if seen is None else value > F.lit(seen)
        else:  # and last when descending
            later = F.lit(False) if seen is None else (value < F.lit(seen)) | value.isNull()
        reached |= so_far & F.coalesce(later, F.lit(False))
        so_far &= value.eqNullSafe(F.lit(seen))
    return df.where(reached | so_far).orderBy(*sort_keys(order)).offset(shown).limit(size)
