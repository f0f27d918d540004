"""The tables behind the bar, line and map charts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.counts import (
    VISIT_DATE,
    interval_counts,
    summary_line,
    top_items,
    with_percentage,
)
from cohortspark.operators.filters import quoted
from cohortspark.operators.joins import unresolved_places, with_geocodes
from cohortspark.operators.places import busiest_place, place_counts

# Fixed value: the default of the item filter.
ITEMS = 5


@dataclass(frozen=True)
class ItemFilter:
    """Keep the ``n`` largest, or smallest, items of each interval."""

    n: int = ITEMS
    ascending: bool = False
    mode: str = "parity"


def chart_bar(
    df: DataFrame,
    factors: Sequence[str],
    interval: str,
    proportional: bool = False,
    items: ItemFilter | None = None,
    ts: str = VISIT_DATE,
) -> DataFrame:
    """``factors, interval, total``, or ``percentage`` of the interval when proportional."""
    factors = list(factors)
    if not 1 <= len(factors) <= 2:
        raise ValueError("a chart takes one or two factors")
    return chart_of_counts(interval_counts(df, factors, interval, ts), factors, interval, proportional, items)


def chart_of_counts(
    counts: DataFrame, factors: list[str], interval: str, proportional: bool = False, items: ItemFilter | None = None
) -> DataFrame:
    """``chart_bar`` from rows already counted: ``factors, interval, total``."""
    y = "percentage" if proportional else "total"
    chart = with_percentage(counts, interval) if proportional else counts
    if items is not None:
        chart = top_items(
            chart,
            by=[interval] + factors[1:],
            factors=factors,
            n=items.n,
            y=y,
            ascending=items.ascending,
            mode=items.mode,
        )
    return chart.select(*map(quoted, factors), quoted(interval), y)


def chart_line(
    df: DataFrame,
    factors: Sequence[str],
    interval: str,
    proportional: bool = False,
    items: ItemFilter | None = None,
    func: str = "none",
    ts: str = VISIT_DATE,
) -> tuple[DataFrame, DataFrame | None]:
    """The lines, as for ``chart_bar``, and the summary line unless ``func`` is "none"."""
    lines = chart_bar(df, factors, interval, proportional, items, ts)
    if func == "none":
        return lines, None
    y = "percentage" if proportional else "total"
    facet = factors[1] if len(factors) == 2 else None
    return lines, summary_line(lines, interval, func, y, facet)


@dataclass(frozen=True)
class MapChart:
    """Places with count and position, places still to be looked up, and the centre."""

    places: DataFrame
    unresolved: DataFrame
    center: DataFrame


def chart_map(df: DataFrame, level: str, geocodes: DataFrame, country: str = "India") -> MapChart:
    return map_of_counts(place_counts(df, level), geocodes, country)


def map_of_counts(counts: DataFrame, geocodes: DataFrame, country: str = "India") -> MapChart:
    """``chart_map`` from places already counted: ``place, total``."""
    places = with_geocodes(counts, geocodes)
    return MapChart(
        places=places,
        unresolved=unresolved_places(counts, geocodes, country).select("place", "lookup"),
        center=busiest_place(places.select("place", F.col("total"), "lat", "lon")),
    )
