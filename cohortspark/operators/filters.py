"""Row filters, column choice and the paged table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from cohortspark.functions import any_present

FULL_NAME = "FULLY_SPECIFIED"


def active(df: DataFrame) -> DataFrame:
    """Rows that are not voided; some databases hand the flag over as a boolean."""
    if isinstance(df.schema["voided"].dataType, BooleanType):
        return df.where(~F.col("voided"))
    return df.where(F.col("voided") == 0)


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def full_concept_names(concepts: DataFrame) -> DataFrame:
    """``concept_id, name`` of the fully specified names."""
    return concepts.where(F.col("concept_name_type") == FULL_NAME).select("concept_id", "name")


def lookup_concept(concepts: DataFrame, name: str) -> Column:
    """The id of the one concept called ``name``, as a scalar subquery.

    Spark raises an error when several concepts match; when none does the id is NULL and a
    filter on it keeps nothing.
    """
    return full_concept_names(concepts).where(F.col("name") == name).select("concept_id").scalar()


def single_concept(concepts: DataFrame, name: str) -> Column:
    """The id of the one concept called ``name`` as a literal, NULL when there is none.

    Looked up right away, at most two rows: a literal reaches the scan of the large table,
    also in a database, which a subquery would not.
    """
    named = full_concept_names(concepts).where(F.col("name") == name)
    found = [row[0] for row in named.select("concept_id").limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"several concepts are called {name!r}")
    return F.lit(found[0] if found else None).cast("bigint")


def in_range(df: DataFrame, ts: str, start: date, end: date) -> DataFrame:
    """Rows of the days ``start`` to ``end``, both included."""
    stop = end + timedelta(days=1)
    first = F.lit(start.isoformat()).cast("timestamp_ntz")
    return df.where((F.col(ts) >= first) & (F.col(ts) < F.lit(stop.isoformat()).cast("timestamp_ntz")))


def in_range_unless_all(
    df: DataFrame, ts: str, start: date | None, end: date | None, fetch_all: bool
) -> DataFrame:
    """``in_range``, or every row when ``fetch_all`` is set."""
    if fetch_all:
        return df
    if start is None or end is None:
        raise ValueError("a start and an end date are needed unless fetch_all is set")
    return in_range(df, ts, start, end)


def any_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in at least one of ``columns``."""
    return df.where(any_present(*map(quoted, columns)))


def quoted(name: str) -> Column:
    """A column by its run-time name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that can be bucketed into ranges."""
    return [field.name for field in df.schema if isinstance(field.dataType, NumericType)]


def numeric_summary(df: DataFrame) -> DataFrame:
    """One row per numeric column: name, rows with a value, least and greatest value."""
    names = numeric_columns(df)
    if not names:
        raise ValueError("the table has no numeric column")
    facts = []
    for i, name in enumerate(names):
        value = quoted(name).cast("double")
        facts += [
            F.count(value).alias(f"n{i}"),
            F.min(value).alias(f"least{i}"),
            F.max(value).alias(f"greatest{i}"),
        ]
    lines = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"n{i}").alias("n"),
            F.col(f"least{i}").alias("least"),
            F.col(f"greatest{i}").alias("greatest"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*facts).select(F.inline(F.array(*lines)))


def table_view(
    df: DataFrame,
    filters: dict[str, object] | None = None,
    order_by: Sequence[tuple[str, bool]] = (),
    page: int = 1,
    size: int = 10,
    after: Mapping[str, object] | None = None,
    shown: int = 1,
) -> DataFrame:
    """One page of a filtered and sorted table, by its number or after the last row seen.

    A filter is a ``(low, high)`` pair for numbers and dates (None leaves a side open; a date as
    upper end of a timestamp includes its day), a
    list for a set of accepted values, or text to be found anywhere, ignoring case.
    ``order_by`` holds ``(column, ascending)`` pairs; every other column follows as a
    tie-break, so the pages of a table neither overlap nor miss rows.

    The first page, and the page after the row ``after`` (a value per column; ``shown`` rows equal to it were
    shown already), keep the least ``size`` rows. Any other page sorts and writes the table, and reads
    its own rows; ``SortedPages`` does that once for many pages.
    """
    # the pages module builds on this one
    from cohortspark.operators.pages import SortedPages, page_after, sort_keys, total_order

    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    for name, wanted in (filters or {}).items():
        df = df.where(_accepts(df, name, wanted))
    if after is not None:
        return page_after(df, after, size, order_by, shown)
    if page == 1:
        return df.orderBy(*sort_keys(total_order(df, order_by))).limit(size)
    return SortedPages(df, order_by).page(page, size)


def _accepts(df: DataFrame, name: str, wanted: object) -> Column:
    value, kind = quoted(name), df.schema[name].dataType
    if isinstance(wanted, list):
        return value.isin(wanted)
    if isinstance(kind, StringType):
        return F.lower(value).contains(str(wanted).lower())
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise ValueError(f"column {name!r} cannot be filtered")
    low, high = wanted
    accepted = value.isNotNull()
    if low is not None:
        accepted &= value >= F.lit(low)
    if high is None:
        return accepted
    whole_day = isinstance(high, date) and not isinstance(high, datetime)
    if whole_day and isinstance(kind, (TimestampType, TimestampNTZType)):
        return accepted & (value < F.lit(high + timedelta(days=1)))
    return accepted & (value <= F.lit(high))
