"""Value expressions: range membership, missing values, exact percentages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_between(value: Column, low: float, high: float, name: str) -> Column:
    """``name`` when ``low <= value <= high``, else NULL."""
    return F.when(value.between(low, high), F.lit(name))


def is_missing(value: Column) -> Column:
    return value.isNull()


def any_present(*values: Column) -> Column:
    return reduce(lambda left, right: left | right, [value.isNotNull() for value in values])


def round_percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two decimals, ties to even.

    Done on integers: a division to double would blur the exact ties.
    """
    scaled = part.cast("bigint") * 10000
    rest = scaled % whole
    # scaled - rest is a multiple of whole, so the quotient is whole up to double noise
    down = F.round((scaled - rest) / whole).cast("bigint")
    up = (2 * rest > whole) | ((2 * rest == whole) & (down % 2 == 1))
    return (down + up.cast("int")) / F.lit(100.0)


def nulls_last(value: Column) -> Column:
    """``value`` as a struct that compares like ``ORDER BY value NULLS LAST``."""
    return F.struct(value.isNull().alias("absent"), value.alias("value"))


def strict_sum(value: Column) -> Column:
    """Sum that is NULL as soon as one value is NULL.

    Adds decimals, so the order of addition cannot change the result.
    """
    complete = F.count(F.lit(1)) == F.count(value)
    return F.when(complete, F.sum(value.cast("decimal(24,6)")).cast("double"))
