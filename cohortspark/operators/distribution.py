"""Histograms, box statistics and scatter points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.counts import VISIT_DATE, with_interval
from cohortspark.operators.filters import quoted
from cohortspark.session import materialize

# Default number of bins, width used when all values are equal, tolerance
# on a bin's edge as a share of its width, whisker length in interquartile ranges.
DEFAULT_BINS = 30
WIDTH_OF_CONSTANT = 0.1
EDGE_TOLERANCE = 1e-8
WHISKER = 1.5
QUARTILES = (0.25, 0.5, 0.75)


def histogram(
    df: DataFrame,
    x: str,
    width: float | None = None,
    fill: str | None = None,
    bins: int = DEFAULT_BINS,
) -> DataFrame:
    """``center [, fill], n``: rows per bin of ``width``.

    Bins are centred on multiples of the width and closed on the right. Without a width the
    range of the data is divided by ``bins - 1``.
    """
    if width is not None and width <= 0:
        raise ValueError("the bin width must be positive")
    values = df.where(_finite(x))
    value = quoted(x).cast("double")
    keys = [quoted(fill)] if fill else []
    # One row first: the width, and the lowest bin, which follows from the minimum.
    size = F.lit(float(width)) if width is not None else _bin_width(value, bins)
    facts = values.agg(F.struct(F.min(value).alias("least"), size.alias("width")).alias("facts")).scalar()
    # The lowest edge is closed too: a minimum that lies on an edge belongs to the bin above.
    lowest = F.floor((F.col("facts.least") - F.col("facts.width") / 2) / F.col("facts.width")) + 1
    bin_of = F.ceil((F.col("x") - F.col("facts.width") / 2) / F.col("facts.width") - EDGE_TOLERANCE)
    return (
        values.select(*keys, value.alias("x"), facts.alias("facts"))
        .groupBy((F.greatest(bin_of, lowest) * F.col("facts.width")).alias("center"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _bin_width(value: Column, bins: int) -> Column:
    if bins < 2:
        raise ValueError("at least two bins are needed")
    spread = F.max(value) - F.min(value)
    return F.when(spread > 0, spread / (bins - 1)).otherwise(WIDTH_OF_CONSTANT)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    probabilities: Sequence[float] = QUARTILES,
    accuracy: int = 10_000,
) -> DataFrame:
    """``keys, q0, q1, ...``: exact quantiles of ``y`` by linear interpolation.

    Spark's own ``percentile`` gathers all distinct values of a group in one task. Here a
    mergeable sketch first brackets each quantile; the values between brackets are only
    counted. Inside, the bracket is cut into slices: the counts per slice tell which one
    holds a quantile, and only that slice is ranked value by value. Groups of up to
    ``accuracy`` rows are one bracket.
    """
    values = df.where(quoted(y).isNotNull()).select(
        *[quoted(key).alias(f"key_{i}") for i, key in enumerate(keys)],
        quoted(y).cast("double").alias("y"),
    )
    names = [f"key_{i}" for i in range(len(keys))]
    found = _brackets(values, names, probabilities, accuracy)
    brackets = _prefixed(materialize(found, "brackets"), names, "bracket")
    counted = (
        values.join(brackets, _same(values, brackets, names, "bracket"))
        .select(*names, "size", "y", _bracket_of(len(probabilities)).alias("at"))
        .where(F.col("at").isNotNull())
        .select(*names, "size", "at.*", F.when(F.col("at.slice") > 0, F.col("y")).alias("y"))
        .groupBy(*names, "size", "bracket", "slice", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    slices = _slices_with_quantiles(counted, names, probabilities)
    place = [*names, "bracket", "slice"]
    slices = _prefixed(slices, place, "in")
    in_order = Window.partitionBy(*place).orderBy("y")
    in_order = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.join(slices, _same(counted, slices, place, "in")).withColumn(
        "upto", F.col("start") + F.sum("n").over(in_order)
    )
    solved = ranked.groupBy(*names, "size").agg(
        *[
            F.expr(f"max(case when {_holds(position)} then y end) as {end}_{i}")
            for i, p in enumerate(probabilities)
            for end, position in zip(("lower", "upper"), _positions(p), strict=True)
        ]
    )
    return solved.select(
        *[F.col(name).alias(key) for name, key in zip(names, keys, strict=True)],
        *[_interpolated(i, p).alias(f"q{i}") for i, p in enumerate(probabilities)],
    )


def _prefixed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({name: f"{prefix}_{name}" for name in names})


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Equal in all of ``names``. NULL-safe also where no NULL occurs: a plain equality would
    add a filter to one reader of a shared table, and Spark would compute it twice."""
    pairs = [left[name].eqNullSafe(right[f"{prefix}_{name}"]) for name in names]
    return reduce(lambda one, other: one & other, pairs)


def _bracket_of(n: int) -> Column:
    """Number of the first bracket that ends at or after ``y`` and the slice of it that ``y``
    is in, 0 when ``y`` comes before the bracket; NULL behind the last one."""
    cases = [
        f"""when y <= high_{i} then named_struct('bracket', {i}, 'slice', case
          when y < low_{i} then 0
          when high_{i} > low_{i} then
            1 + cast(floor((y - low_{i}) / (high_{i} - low_{i}) * slices) as int)
          else 1 end)"""
        for i in range(n)
    ]
    return F.expr(f"case {' '.join(cases)} end")


def _slices_with_quantiles(
    counted: DataFrame, names: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """``names, bracket, slice, start``: the slices a quantile lies in, and the number of
    values of the group before each."""
    totals = counted.groupBy(*names, "size", "bracket", "slice").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*names).orderBy("bracket", "slice")
    in_order = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = totals.withColumn("upto", F.sum("n").over(in_order))
    wanted = [_holds(position) for p in probabilities for position in _positions(p)]
    return placed.where(f"slice > 0 and ({' or '.join(wanted)})").selectExpr(
        *names, "bracket", "slice", "upto - n as start"
    )


def _positions(p: float) -> tuple[str, str]:
    """The two places in the sorted group that a quantile lies between, counted from 0."""
    below = f"floor({float(p)}D * (size - 1))"
    return below, f"least({below} + 1, size - 1)"


def _holds(position: str) -> str:
    return f"(upto - n <= {position} and {position} < upto)"


def _interpolated(i: int, p: float) -> Column:
    below, _ = _positions(p)
    return F.expr(
        f"""case when lower_{i} is not null and upper_{i} is not null
        then lower_{i} + ({float(p)}D * (size - 1) - {below}) * (upper_{i} - lower_{i})
        else cast(raise_error('a quantile lies outside its bracket; raise the accuracy')
          as double) end"""
    )


def _brackets(
    values: DataFrame, names: Sequence[str], probabilities: Sequence[float], accuracy: int
) -> DataFrame:
    """Group size, number of slices and, per quantile, two values that hold it between them.

    The sketch is off by at most ``size / accuracy`` ranks. The bracket reaches twenty times
    as far on either side, which also covers the rounding of ranks.
    """
    reach = 20.0 / accuracy
    lows = [max(p - reach, 0.0) for p in probabilities]
    highs = [min(p + reach, 1.0) for p in probabilities]
    grouped = values.groupBy(*names).agg(
        F.count(F.lit(1)).alias("size"),
        F.min("y").alias("least"),
        F.max("y").alias("greatest"),
        F.percentile_approx("y", lows + highs, accuracy).alias("sketch"),
    )
    ends = []
    for i, (low, high) in enumerate(zip(lows, highs, strict=True)):
        whole = f"size <= {accuracy}"
        ends += [
            f"if({whole} or {low}D = 0, least, sketch[{i}]) as low_{i}",
            f"if({whole} or {high}D = 1, greatest, sketch[{len(lows) + i}]) as high_{i}",
        ]
    # the root of the group's size: neither the slices nor the rows in one grow in proportion
    slices = "cast(ceil(sqrt(size)) as int) as slices"
    return grouped.selectExpr(*names, "size", slices, *ends)


def box_stats(
    df: DataFrame,
    y: str,
    interval: str,
    fill: str | None = None,
    ts: str = VISIT_DATE,
    approximate: bool = False,
) -> DataFrame:
    """``interval [, fill], q1, median, q3, lower, upper``: one box per group.

    ``lower`` and ``upper`` are the extreme values within 1.5 interquartile ranges of the
    box, and never inside it. Rows without a value or date are left out. ``approximate`` takes
    the quartiles from a sketch, in one pass less.
    """
    return boxes_and_outliers(df, y, interval, fill, ts, approximate)[0]


def box_outliers(
    df: DataFrame,
    y: str,
    interval: str,
    fill: str | None = None,
    ts: str = VISIT_DATE,
    approximate: bool = False,
) -> DataFrame:
    """``interval [, fill], y``: the values outside the whiskers."""
    return boxes_and_outliers(df, y, interval, fill, ts, approximate)[1]


def boxes_and_outliers(
    df: DataFrame,
    y: str,
    interval: str,
    fill: str | None = None,
    ts: str = VISIT_DATE,
    approximate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The boxes and the outliers of the same values.

    The values, two or three columns, are needed several times with all joins behind them, so
    they are written once.
    """
    values, keys = _box_values(df, y, interval, fill, ts)
    values = materialize(values, "values")
    fenced = _join_boxes(values, _quartiles(values, keys, y, approximate), keys)
    inside = ~_outlying(y)
    least = F.min(F.when(inside, quoted(y))).cast("double")
    greatest = F.max(F.when(inside, quoted(y))).cast("double")
    boxes = fenced.groupBy(*map(quoted, keys), "q1", "median", "q3").agg(
        F.least("q1", least).alias("lower"), F.greatest("q3", greatest).alias("upper")
    )
    return boxes, fenced.where(_outlying(y)).select(*map(quoted, keys), quoted(y))


def _box_values(
    df: DataFrame, y: str, interval: str, fill: str | None, ts: str
) -> tuple[DataFrame, list[str]]:
    keys = [interval] + ([fill] if fill else [])
    values = with_interval(df, interval, ts).select(*map(quoted, keys), quoted(y))
    return values.where(_finite(y) & quoted(interval).isNotNull()), keys


def _finite(name: str) -> Column:
    """True for numbers; missing, infinite and undefined values are not drawn."""
    return F.abs(quoted(name).cast("double")) < F.lit(float("inf"))


def _quartiles(values: DataFrame, keys: Sequence[str], y: str, approximate: bool) -> DataFrame:
    if approximate:
        sketch = F.percentile_approx(quoted(y).cast("double"), list(QUARTILES))
        found = values.groupBy(*map(quoted, keys)).agg(sketch.alias("sketch"))
        quartiles = [F.col("sketch")[i] for i in range(3)]
    else:
        found = group_quantiles(values, keys, y)
        quartiles = [F.col(f"q{i}") for i in range(3)]
    boxes = found.select(
        *[quoted(key).alias(f"box_{i}") for i, key in enumerate(keys)],
        *[q.alias(name) for q, name in zip(quartiles, ("q1", "median", "q3"), strict=True)],
    )
    # One row per box. Written, its size is known before the join with all the values, which
    # then need not be shuffled when it is small.
    return materialize(boxes, "boxes")


def _join_boxes(values: DataFrame, quartiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = [values[f"`{key}`"].eqNullSafe(quartiles[f"box_{i}"]) for i, key in enumerate(keys)]
    joined = values.join(quartiles, reduce(lambda left, right: left & right, same))
    return joined.drop(*[f"box_{i}" for i in range(len(keys))])


def _outlying(y: str) -> Column:
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    return (quoted(y) < F.col("q1") - reach) | (quoted(y) > F.col("q3") + reach)


def scatter(df: DataFrame, x: str, y: str, color: str = "Gender", max_points: int | None = None) -> DataFrame:
    """``x, y, color, n``: the points to draw, those drawn on top of each other merged.

    With ``max_points``, points in the same cell of a grid are merged as well where there are more: the finest of
    the grids of 1, 2, 4 ... cells a side with at most so many points, each drawn in the middle of its cell. Colours
    are never merged, so a single cell with more of them exceeds the limit.
    """
    points = df.where(_finite(x) & _finite(y))
    merged = points.groupBy(quoted(x), quoted(y), quoted(color)).agg(F.count(F.lit(1)).alias("n"))
    if max_points is None:
        return merged
    if max_points < 1:
        raise ValueError("max_points starts at 1")
    merged = materialize(merged, "points")
    if merged.limit(max_points + 1).count() <= max_points:
        return merged
    return _thinned(merged, x, y, color, max_points)


def _thinned(points: DataFrame, x: str, y: str, color: str, max_points: int) -> DataFrame:
    """Counts per cell. The points are read once, for the finest grid; the counts of each coarser grid are
    sums of those of the finer one."""
    finest = max_points.bit_length()
    edges = points.agg(*[f(quoted(c).cast("double")).alias(f"{f.__name__}_{i}") for i, c in enumerate((x, y)) for f in (F.min, F.max)])
    edges = [float(v) for v in edges.first()]  # one row
    cells = points.groupBy(
        *[_cell(quoted(c).cast("double"), *edges[2 * i : 2 * i + 2], 2**finest).alias(f"cell_{i}") for i, c in enumerate((x, y))],
        quoted(color).alias("cell_color"),
    )
    cells = materialize(cells.agg(F.sum("n").alias("n")), "cells")
    level = F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level")
    coarser = lambda i, by: F.expr(f"shiftright(cell_{i}, {finest} - {by})")
    seen = cells.select(level, "cell_0", "cell_1", "cell_color")
    seen = seen.groupBy("level", coarser(0, "level"), coarser(1, "level"), "cell_color").agg(F.count(F.lit(1)).alias("n"))
    fits = seen.groupBy("level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_points).agg(F.max("level"))
    chosen = fits.first()[0] or 0
    side = 2**chosen
    middle = lambda i: F.lit(edges[2 * i]) + (F.col(f"cell_{i}") + 0.5) * F.lit(edges[2 * i + 1] - edges[2 * i]) / F.lit(float(side))
    grid = cells.select(coarser(0, chosen).alias("cell_0"), coarser(1, chosen).alias("cell_1"), "cell_color", "n")
    grid = grid.groupBy("cell_0", "cell_1", "cell_color").agg(F.sum("n").alias("n"))
    return grid.select(middle(0).alias(x), middle(1).alias(y), F.col("cell_color").alias(color), "n")


def _cell(value: Column, least: float, greatest: float, side: int) -> Column:
    if greatest == least:
        return F.lit(0).cast("long")
    at = F.floor((value - F.lit(least)) / F.lit(greatest - least) * F.lit(float(side)))
    return F.least(at, F.lit(side - 1).cast("long"))
