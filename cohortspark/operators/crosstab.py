"""Contingency tables over one or two factors.

Rows that miss a factor are not counted. The cells that have rows come first; ``dense=True``
adds the empty ones, so that every combination of the levels present is a cell and the size
is the product of the two numbers of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.filters import quoted
from cohortspark.session import materialize

LEVELS_PER_BLOCK = 1024


def crosstab(
    df: DataFrame,
    factor1: str,
    factor2: str | None = None,
    proportional: bool = False,
    dense: bool = False,
) -> DataFrame:
    """``factor1 [, factor2], n [, prop]``; ``prop`` is the share of the grand total.

    ``dense`` gives levels of factor1 x levels of factor2 rows.
    """
    factors = [factor1] + ([factor2] if factor2 else [])
    counted = df.groupBy(*map(quoted, factors)).agg(F.count(F.lit(1)).alias("n"))
    if factor2 and dense:
        # The levels of both factors and the cells come from here: read the data once.
        counted = materialize(counted, "cells")
    cells = counted.where(_complete(factors))
    if factor2 and dense:
        cells = _fill(counted, cells, factor1, factor2)
    if proportional:
        total = counted.where(_complete(factors)).agg(F.sum("n")).scalar()
        cells = cells.withColumn("prop", F.col("n") / total)
    return cells


def crosstab_wide(
    df: DataFrame, factor1: str, factor2: str, levels: Sequence[str] | None = None
) -> DataFrame:
    """One row per level of ``factor1``, one column per level of ``factor2``.

    Pass ``levels`` to fix the columns; otherwise they are looked up first, within the
    limit on columns that Spark sets for every pivot.
    """
    counted = df.groupBy(quoted(factor1), quoted(factor2)).agg(F.count(F.lit(1)).alias("n"))
    if levels is None:
        levels = _column_levels(counted, factor2)
    pivoted = counted.groupBy(quoted(factor1)).pivot(factor2, list(levels)).agg(F.sum("n"))
    return pivoted.where(quoted(factor1).isNotNull()).na.fill(0, list(levels))


def _column_levels(counted: DataFrame, factor: str) -> list[str]:
    most = int(counted.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = counted.where(quoted(factor).isNotNull()).select(quoted(factor)).distinct()
    levels = [row[0] for row in found.orderBy(quoted(factor)).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{factor!r} has more than {most} levels; use the long form")
    return levels


def _complete(factors: Sequence[str]) -> Column:
    present = F.lit(True)
    for factor in factors:
        present &= quoted(factor).isNotNull()
    return present


def _fill(counted: DataFrame, cells: DataFrame, factor1: str, factor2: str) -> DataFrame:
    """All pairs of levels with their count, 0 where there is none.

    The pairs come from an equality join on a grid of blocks: each level falls in one block
    of its factor and is copied to every block of the other. A factor has one block per
    ``LEVELS_PER_BLOCK`` levels, so a short one costs the other no copies, and neither list of
    levels has to fit into one task.
    """
    rows, columns = _levels(counted, factor1, "level_1"), _levels(counted, factor2, "level_2")
    blocks_1, blocks_2 = _blocks(rows), _blocks(columns)
    rows = rows.withColumns({"block_1": _block("level_1", blocks_1), "block_2": _every(blocks_2)})
    columns = columns.withColumns({"block_2": _block("level_2", blocks_2), "block_1": _every(blocks_1)})
    pairs = rows.join(columns, ["block_1", "block_2"])
    match = (pairs.level_1 == cells[f"`{factor1}`"]) & (pairs.level_2 == cells[f"`{factor2}`"])
    return pairs.join(cells, match, "left").select(
        F.col("level_1").alias(factor1),
        F.col("level_2").alias(factor2),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _levels(counted: DataFrame, factor: str, name: str) -> DataFrame:
    known = counted.where(quoted(factor).isNotNull())
    return known.select(quoted(factor).alias(name)).distinct()


def _blocks(levels: DataFrame) -> Column:
    n = F.ceil(F.count(F.lit(1)) / LEVELS_PER_BLOCK)
    return levels.agg(F.greatest(n, F.lit(1)).cast("long").alias("blocks")).scalar()


def _block(level: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(level), blocks)


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
