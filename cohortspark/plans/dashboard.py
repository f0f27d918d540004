"""Re-running saved charts on a new date range."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import INTERVALS
from cohortspark.operators.counts import VISIT_DATE, with_interval
from cohortspark.operators.derive import ColumnDefinition, derive_column, range_names, stack
from cohortspark.operators.distribution import boxes_and_outliers, histogram, scatter
from cohortspark.operators.filters import quoted
from cohortspark.operators.places import busiest_place, check_level, place_counts
from cohortspark.plans.charts import chart_bar, chart_of_counts, map_of_counts
from cohortspark.plans.datasets import fetch
from cohortspark.session import materialize
from cohortspark.sources.tables import Tables

OUTLIERS, CENTER, TO_LOOK_UP = "outliers", "center", "to look up"

# The chart types a saved plot can have.
TYPES = ("Table", "Bar Chart", "Histogram", "Scatter Plot", "Map Plot", "Line Chart", "Box Plot")


COUNTED = ("Bar Chart", "Line Chart", "Map Plot")


@dataclass(frozen=True)
class PlotSpec:
    """A saved chart."""

    title: str
    type: str
    factor1: str
    factor2: str | None = None
    interval: str = "Years"
    proportional: bool = False

    def __post_init__(self):
        if not self.title:
            raise ValueError("a saved plot needs a title")
        if not self.factor1:
            raise ValueError(f"{self.title!r} needs a first factor")
        if self.type not in TYPES:
            raise ValueError(f"{self.title!r} has unknown type {self.type!r}")
        if self.interval not in INTERVALS:
            raise ValueError(f"{self.title!r} has unknown interval {self.interval!r}")
        if self.type == "Scatter Plot" and not self.factor2:
            raise ValueError(f"{self.title!r} needs a second factor")

    @property
    def factors(self) -> list[str]:
        return [self.factor1] + ([self.factor2] if self.factor2 else [])

    @classmethod
    def from_spec(cls, title: str, spec: dict) -> PlotSpec:
        """From the stored form: ``factor1, factor2, timeInterval, isProportional, type``."""
        return cls(
            title=title,
            type=spec.get("type", ""),
            factor1=spec.get("factor1", ""),
            factor2=spec.get("factor2") or None,
            interval=spec.get("timeInterval", "Years"),
            proportional=bool(spec.get("isProportional", False)),
        )

    @classmethod
    def all_from_json(cls, text: str) -> list[PlotSpec]:
        return [cls.from_spec(title, spec) for title, spec in json.loads(text).items()]


def run_dashboard(
    tables: Tables,
    dataset: str,
    plots: Sequence[PlotSpec],
    start: date,
    end: date,
    columns: dict[str, ColumnDefinition] | None = None,
    geocodes: DataFrame | None = None,
    as_of: date | None = None,
    ranges: dict[str, tuple[date, date]] | None = None,
) -> dict[str, DataFrame]:
    """Title -> chart table, for every saved plot that is drawn (a "Table" is not).

    A box plot also has a table of its outliers, a map one of its centre and one of the places to
    look up; their keys are ``part_of(title, OUTLIERS)`` and so on. ``ranges`` gives plots, by
    title, a date range of their own. The dataset is fetched once per distinct range and what the
    plots read of it is written as a table; ``cohortspark.session.release`` deletes those tables.
    All bar, line and map plots of a range are counted in one pass over it.
    """
    columns = columns or {}
    drawn = [plot for plot in plots if plot.type != "Table"]
    by_range: dict[tuple[date, date], list[PlotSpec]] = {}
    for plot in drawn:
        by_range.setdefault((ranges or {}).get(plot.title, (start, end)), []).append(plot)
    kept = {}
    for (first, last), group in by_range.items():
        flat = fetch(dataset, tables, first, last, as_of=as_of)
        read = set().union(*(_columns_read(plot, columns) for plot in group))
        kept[first, last] = materialize(flat.select(*[quoted(c) for c in flat.columns if c in read]), "dashboard")
    counted = {}
    for key, group in by_range.items():
        counted |= count_tables(kept[key], [plot for plot in group if plot.type in COUNTED], columns)
    charts = {}
    for plot in drawn:
        flat = kept[(ranges or {}).get(plot.title, (start, end))]
        if plot.title in counted:
            parts = _plot_of_counts(counted[plot.title], plot, geocodes)
        else:
            parts = run_plot(flat, plot, columns, geocodes)
        for part, chart in parts.items():
            charts[part_of(plot.title, part)] = chart
    return charts


def part_of(title: str, part: str = "") -> str:
    """The key of a part of a chart; its main table goes by the title alone."""
    return f"{title} / {part}" if part else title


def _columns_read(plot: PlotSpec, columns: dict[str, ColumnDefinition]) -> set[str]:
    """Columns of the dataset that a plot needs; time charts read the visit date, scatter plots
    are coloured by gender."""
    read = {VISIT_DATE, "Gender"}
    for factor in plot.factors:
        found = columns.get(factor)
        read |= {found.first, found.second} - {None} if found else {factor}
    return read


def count_tables(flat: DataFrame, plots: Sequence[PlotSpec], columns: dict[str, ColumnDefinition]) -> dict[str, DataFrame]:
    """Title -> the counts of a bar, line or map plot, all from one pass over ``flat``.

    Grouping sets count each combination of factors and interval once, in one shuffle. A derived column gives a row
    more than once; the plots without that column count its first copy only. The counts are
    written, so that each plot reads its own.
    """
    if not plots:
        return {}
    derived = sorted({factor for plot in plots for factor in plot.factors if factor in columns})
    names = [range_names(flat, columns[name]) for name in derived]
    wide = flat.withColumns({f"ranges {i}": found for i, found in enumerate(names)})
    for interval in sorted({plot.interval for plot in plots if plot.type != "Map Plot"}):
        wide = with_interval(wide, interval)
    wide = wide.drop(*derived)
    for i, name in enumerate(derived):
        others = [quoted(c) for c in wide.columns]
        wide = wide.select(*others, F.posexplode_outer(quoted(f"ranges {i}")).alias(f"copy {i}", name))
    keys = {}
    for plot in plots:
        if plot.type == "Map Plot":
            check_level(plot.factor1)
        keys[plot.title] = [plot.factor1] if plot.type == "Map Plot" else [*dict.fromkeys([*plot.factors, plot.interval])]
    grouped = sorted({name for key in keys.values() for name in key})
    sets = sorted({tuple(sorted(key)) for key in keys.values()})
    own = sorted({tuple(name for name in derived if name in key) for key in keys.values()})
    first = lambda kept: [F.coalesce(F.col(f"`copy {i}`"), F.lit(0)) == 0 for i, name in enumerate(derived) if name not in kept]
    totals = [F.count_if(reduce(Column.__and__, first(kept), F.lit(True))).alias(f"total {k}") for k, kept in enumerate(own)]
    counts = wide.groupingSets([list(map(quoted, s)) for s in sets], *map(quoted, grouped))
    counts = materialize(counts.agg(F.grouping_id().alias("grouping set"), *totals), "counts")
    tables = {}
    for plot in plots:
        key = keys[plot.title]
        left_out = sum(1 << (len(grouped) - 1 - i) for i, name in enumerate(grouped) if name not in key)
        kept = tuple(name for name in derived if name in key)
        total = quoted(f"total {own.index(kept)}")
        rows = counts.where((F.col("`grouping set`") == left_out) & (total > 0))
        for name in kept:  # a row inside no range is not counted
            rows = rows.where(quoted(name).isNotNull())
        tables[plot.title] = rows.select(*map(quoted, key), total.alias("total"))
    return tables


def _plot_of_counts(counts: DataFrame, plot: PlotSpec, geocodes: DataFrame | None) -> dict[str, DataFrame]:
    if plot.type != "Map Plot":
        return {"": chart_of_counts(counts, plot.factors, plot.interval, plot.proportional)}
    places = counts.where(quoted(plot.factor1).isNotNull()).select(quoted(plot.factor1).alias("place"), "total")
    return _map_parts(places, geocodes)


def _map_parts(places: DataFrame, geocodes: DataFrame | None) -> dict[str, DataFrame]:
    if geocodes is not None:
        chart = map_of_counts(places, geocodes)
        return {"": chart.places, CENTER: chart.center, TO_LOOK_UP: chart.unresolved}
    unknown = F.lit(None).cast("double")
    places = places.withColumns({"lat": unknown, "lon": unknown})
    return {"": places, CENTER: busiest_place(places)}


def run_plot(
    flat: DataFrame,
    plot: PlotSpec,
    columns: dict[str, ColumnDefinition],
    geocodes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of one plot by part ("" is the chart), without item filter or summary line."""
    for factor in plot.factors:
        if factor in columns:
            flat = derive_column(flat, columns[factor])
    if plot.type in ("Bar Chart", "Line Chart"):
        return {"": chart_bar(flat, plot.factors, plot.interval, plot.proportional)}
    if plot.type == "Histogram":
        return {"": histogram(flat, plot.factor1, fill=plot.factor2)}
    if plot.type == "Scatter Plot":
        return {"": scatter(flat, plot.factor1, plot.factor2)}
    if plot.type == "Box Plot":
        boxes, outliers = boxes_and_outliers(flat, plot.factor1, plot.interval, plot.factor2)
        return {"": boxes, OUTLIERS: outliers}
    if plot.type == "Map Plot":
        return _map_parts(place_counts(flat, plot.factor1), geocodes)
    raise ValueError(f"a plot of type {plot.type!r} is not drawn")


def dashboard_rows(plots: Sequence[PlotSpec], charts: dict[str, DataFrame]) -> DataFrame:
    """All charts as one table ``title, factor1, factor2, bucket, measure, value``."""
    rows = []
    for plot in plots:
        for part in ("", OUTLIERS, CENTER, TO_LOOK_UP):
            if (title := part_of(plot.title, part)) in charts:
                rows.append(_long(plot, part, charts[title]))
    return stack(rows)


def _long(plot: PlotSpec, part: str, chart: DataFrame) -> DataFrame:
    text, none = "string", F.lit(None)
    factor1, factor2, bucket = none, none, none
    if plot.type in ("Bar Chart", "Line Chart"):
        measures = ["percentage" if plot.proportional else "total"]
        factor1 = quoted(plot.factor1)
        factor2 = quoted(plot.factor2) if plot.factor2 else none
        bucket = quoted(plot.interval)
    elif plot.type == "Histogram":
        measures = ["center", "n"]
        factor2 = quoted(plot.factor2) if plot.factor2 else none
    elif plot.type == "Scatter Plot":
        measures = [plot.factor1, plot.factor2, "n"]
        factor1 = quoted("Gender")
    elif plot.type == "Box Plot":
        measures = [plot.factor1] if part == OUTLIERS else ["q1", "median", "q3", "lower", "upper"]
        factor2 = quoted(plot.factor2) if plot.factor2 else none
        bucket = quoted(plot.interval)
    elif part == TO_LOOK_UP:
        chart = chart.withColumn("unknown", F.lit(1))
        measures, factor1, factor2 = ["unknown"], quoted("place"), quoted("lookup")
    else:
        measures = ["total", "lat", "lon"]
        factor1 = quoted("place")
    return chart.select(
        F.lit(part_of(plot.title, part)).alias("title"),
        factor1.cast(text).alias("factor1"),
        factor2.cast(text).alias("factor2"),
        bucket.cast("timestamp_ntz").alias("bucket"),
        F.explode(F.array(*map(_measure, measures))).alias("m"),
    ).select("title", "factor1", "factor2", "bucket", "m.measure", "m.value")


def _measure(name: str) -> Column:
    return F.struct(F.lit(name).alias("measure"), quoted(name).cast("double").alias("value"))
