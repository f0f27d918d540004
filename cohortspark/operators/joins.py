"""Joins on keys.

No join forces a broadcast: the planner broadcasts a side only when its known size is
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.filters import full_concept_names

PAIRS_AT_ONCE = 10_000  # of rows without a key, aimed at in one part of a join
PARTS_PER_TASK = 4  # at most, for each shuffle partition


def with_concept_name(obs: DataFrame, concepts: DataFrame, on: str = "value_coded") -> DataFrame:
    """Add ``name`` of the concept in column ``on``; two names of a concept give two rows."""
    names = full_concept_names(concepts).withColumnRenamed("concept_id", "named_concept_id")
    return obs.join(names, obs[on] == names.named_concept_id).drop("named_concept_id")


def keep_matching(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in column ``key`` of ``keys``."""
    wanted = keys.select(F.col(key or on).alias("wanted_key"))
    return df.join(wanted, df[on] == wanted.wanted_key, "left_semi")


def keep_matching_null_safe(df: DataFrame, keys: DataFrame, on: str, key: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in column ``key`` of ``keys``, where NULL occurs if a key is NULL.

    Rows without ``on`` are not shuffled: they are all kept or all dropped, by a condition of one row.
    """
    has_null = keys.where(F.col(key).isNull()).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    known = keep_matching(df.where(F.col(on).isNotNull()), keys, on, key)
    return known.unionByName(df.where(F.col(on).isNull() & has_null))


def where_concept(df: DataFrame, on: str, concepts: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``on`` is the id of one of ``concepts``.

    The ids are looked up right away: literals reach the scan of ``df``, also in a database.
    This is for the handful of concepts that a caller names; ``keep_matching`` takes any
    number.
    """
    found = concepts.select("concept_id").distinct().collect()
    return df.where(F.col(on).isin(sorted(row[0] for row in found)))


def left_null_safe(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer join in which NULL matches NULL.

    Rows of ``right`` without a key all match the same rows of ``left``, and usually there are
    none. They only take part when there is such a row, which a Parquet scan can tell from its
    footers. Rows of ``left`` without a key are dealt out over parts, each of which gets the rows of
    ``right`` without one. There are as many parts as their pairs fill with PAIRS_AT_ONCE, but no more than
    such rows of ``left`` or than tasks can use; where one side has none, nothing is copied.
    """
    without = [side.where(F.col(key).isNull()).select(F.lit(i).alias("side")) for i, (side, key) in enumerate(((left, left_key), (right, right_key)))]
    sizes = [F.count(F.when(F.col("side") == i, 1)).alias(f"of_{i}") for i in (0, 1)]
    counted = without[0].unionAll(without[1]).agg(F.struct(*sizes).alias("sizes")).scalar()
    missing = [counted.getField("of_0"), counted.getField("of_1")]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without a match go wherever there is room
    dealt = F.when(missing[1] == 0, missing[0]).otherwise(F.ceil(missing[0].cast("double") * missing[1] / PAIRS_AT_ONCE))
    spread = F.greatest(F.lit(1), F.least(dealt, missing[0], F.lit(PARTS_PER_TASK * tasks))).cast("int")
    part = F.when(F.col(left_key).isNull(), F.pmod(_row_hash(left), spread)).otherwise(F.lit(0))
    left = left.withColumn("left_part", part.cast("int"))
    parts = F.when(F.col(right_key).isNull(), F.sequence(F.lit(0), spread - 1))
    right = right.where(F.col(right_key).isNotNull() | (missing[0] > 0)).withColumn(
        "right_part", F.explode(parts.otherwise(F.array(F.lit(0))))
    )
    match = left[left_key].eqNullSafe(right[right_key]) & (left.left_part == right.right_part)
    return left.join(right, match, "left").drop("left_part", "right_part")


def left_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer join in which a NULL key matches nothing.

    A second key deals out the rows without a key by their other columns. Elsewhere it is a
    hash of the key on both sides; a constant would be folded away, and all rows without a key
    would land in one partition.
    """
    kind = left.schema[left_key].dataType
    spread = F.when(F.col(left_key).isNull(), _row_hash(left)).otherwise(F.xxhash64(F.col(left_key)))
    left = left.withColumn("left_spread", spread)
    right = right.withColumn("right_spread", F.xxhash64(F.col(right_key).cast(kind)))
    match = (left[left_key] == right[right_key]) & (left.left_spread == right.right_spread)
    return left.join(right, match, "left").drop("left_spread", "right_spread")


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*["`" + name.replace("`", "``") + "`" for name in df.columns])


def with_geocodes(counts: DataFrame, geocodes: DataFrame, place: str = "place") -> DataFrame:
    """Add ``lat`` and ``lon`` of each place; NULL for a place without a known position."""
    known = geocodes.select(F.col("address").alias("known_address"), "lat", "lon")
    return counts.join(known, counts[place] == known.known_address, "left").drop("known_address")


def unresolved_places(
    counts: DataFrame, geocodes: DataFrame, country: str, place: str = "place"
) -> DataFrame:
    """Places without a known position, with the text to look each of them up by."""
    known = geocodes.select(F.col("address").alias("known_address"))
    missing = counts.join(known, counts[place] == known.known_address, "left_anti")
    return missing.withColumn("lookup", F.concat_ws(" ", F.lit(country), F.col(place)))
