"""Connected components of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the smallest node each linked node reaches: node, label.

    Alternates two steps until nothing changes: every node links its larger neighbours to the
    smallest of its neighbourhood, then its smaller neighbours. Each step is a grouped
    minimum and a many-to-one join, so a node with very many links is not a hot group.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(edges.filter("u <> v").distinct(), "edges")
    before = _signature(edges)
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(smallest).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def _signature(edges: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(digest, F.lit(1 << 31)))).first())
