"""Picking rows of a group by time or order.

Both operators filter a window on its first rank, so Spark cuts each group down inside
every map task before the shuffle (``WindowGroupLimit``): a group holding a large share of
all rows reaches its final task already reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.filters import quoted

PARTS_PER_TASK = 4  # parts of a group for each shuffle partition


def latest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows with the greatest ``ts`` of their group, ties included.

    A group with a missing ``ts`` has no known latest row and is left out: the missing one
    ranks first and is then dropped.

    A group is ranked in parts, dealt out by a hash of the row, so that the ties of a hot group do not meet
    in one task. The greatest time of each part is found beside them, and of these the ones that are the
    greatest of their group: a row per part that exists, as the small side of a join on group and part. So no
    step brings the rows of a group together, and a group has at most as many copies as rows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*map(quoted, df.columns)), F.lit(PARTS_PER_TASK * tasks))
    newest = Window.partitionBy(*map(quoted, keys), "latest_part").orderBy(quoted(ts).desc_nulls_first())
    ranked = df.withColumn("latest_part", part).withColumn("latest_rank", F.rank().over(newest))
    best = ranked.where(F.col("latest_rank") == 1).drop("latest_rank")
    # from all rows rather than from the ranked ones, which would be ranked a second time
    names = [f"latest_{i}" for i in range(len(keys))]
    parts = (
        df.select(*[quoted(key).alias(name) for key, name in zip(keys, names, strict=True)],
                  quoted(ts).alias("latest_ts"), part.alias("part"))
        .groupBy(*names, "part").agg(F.max("latest_ts").alias("latest_ts"), F.bool_or(F.col("latest_ts").isNull()).alias("undated"))
    )
    group = Window.partitionBy(*names)
    parts = parts.withColumn("group_ts", F.max("latest_ts").over(group)).withColumn("undated", F.bool_or("undated").over(group))
    parts = parts.where(~F.col("undated") & (F.col("latest_ts") == F.col("group_ts"))).drop("undated", "group_ts", "latest_ts")
    match = best.latest_part == parts.part
    for key, name in zip(keys, names, strict=True):
        match &= best[f"`{key}`"].eqNullSafe(parts[name])
    return best.join(parts, match, "left_semi").drop("latest_part")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. ``order`` should be total, or the choice is arbitrary."""
    rows = Window.partitionBy(*map(quoted, keys)).orderBy(*order)
    return df.withColumn("row_in_group", F.row_number().over(rows)).where(
        F.col("row_in_group") == 1
    ).drop("row_in_group")


def repeat_rows(df: DataFrame, times: str, chunk: int = 1000) -> DataFrame:
    """Each row as often as its column ``times`` says; the column is dropped.

    Two steps, so that no single row has to hold an array as long as a huge ``times``.
    """
    n = F.col(times)
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / chunk))
    repeats = F.array_repeat(F.lit(1), F.least(n - F.col("chunk_no") * chunk, F.lit(chunk)).cast("int"))
    return (
        df.withColumn("chunk_no", F.explode(chunks))
        .withColumn("copy_no", F.explode(repeats))
        .drop("chunk_no", "copy_no", times)
    )
