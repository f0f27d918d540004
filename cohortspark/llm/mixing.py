"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import WORD
from cohortspark.session import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix"
BLOCK = 4096  # rows without doc_id that are numbered by one row of a task


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Target of each source from rows of (source, size): source, source_size, target.

    Sources in code point order (null last) get ``weights`` in turn and share the total by
    them. A source whose share is above ``most_epochs`` times its size is clamped there and
    the excess goes to the others by weight. Clamping starts with the source that has the
    least room for its weight, so one running sum over the sources in that order finds the
    level at which nobody else is above. Sums are of integers, one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    room = (F.col("source_size") * most_epochs).alias("room")
    sources = sources.withColumn("weight", weight.cast("long")).select("*", room)
    # by room / weight; before: clamped room and weight of those with less room than this one
    order = Window.orderBy(F.col("room").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sources.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    # the first one that is not above its room fixes the level of all after it
    fits = F.col("weight") * F.col("left") <= F.col("room") * F.col("weights_left")
    first = F.min(F.when(fits, F.struct(F.col("room").cast("double") / F.col("weight"), "source",
                                        "left", "weights_left"))).over(everything)
    level = sources.withColumn("fits", fits).withColumn("level", first)
    reached = F.max(F.col("fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    shared = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weights_left").cast("double")
    return level.withColumn("reached", reached).select(
        "source", "source_size",
        F.when(F.col("reached"), F.least(shared, F.col("room").cast("double")))
        .otherwise(F.col("room").cast("double")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source, source_size, target, repeats, taken, one row per row of
    ``docs``. A source is repeated target / source_size times: ``repeats`` whole repetitions of
    every document and, for the rest, a fractional repetition of that share of its words, rounded up
    or down by a seeded hash of doc_id. A source's words miss its target by about the root of its
    number of documents, and no document is taken more than ``most_epochs`` times.

    Null text has size 0, a null source is a source of its own, repeated rows are documents of
    their own, an empty table gives no rows. Rows with a null doc_id and equal source and size
    are rounded together: as many of them up as their share asks for. Only the columns doc_id, source
    and text are read. The table of sources is ranked in one task: it is one row per source.
    """
    sizes = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ), "sizes",
    )
    targets = source_targets(sizes, weights, most_epochs).withColumnRenamed("source", "_source")
    named = sizes.filter("doc_id is not null").withColumn("draw", _draw(seed, F.col("doc_id").cast("string")))
    joined = named.unionByName(_nameless(sizes, seed)).join(targets, F.col("source").eqNullSafe(F.col("_source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    taken = F.least(F.col("size") * most_epochs, F.floor(F.col("size").cast("double") * F.col("share") + F.col("draw")))
    return joined.withColumn("share", share).select(
        "doc_id", "size", "source", "source_size", "target",
        F.floor("share").cast("long").alias("repeats"), taken.cast("long").alias("taken"),
    )


def _draw(seed: str, text: Column) -> Column:
    """A number in [0, 1) for each text."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 8), 16, 10)
    return digits.cast("double") / F.lit(2.0**32)


def _nameless(sizes: DataFrame, seed: str) -> DataFrame:
    """The rows without doc_id, with evenly spaced draws among those of one source and size.

    Such rows are alike, so they are counted and written out again, block by block."""
    counted = sizes.filter("doc_id is null").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    last = F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1
    rows = blocks.repartition("source", "size", "block").withColumn("i", F.explode(F.sequence(F.col("block") * BLOCK, last)))
    shift = _draw(seed, F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("size").cast("string")))
    draw = ((F.col("i") + shift) / F.col("n")).alias("draw")
    return rows.select(F.lit(None).cast("long").alias("doc_id"), "source", "size", draw)
