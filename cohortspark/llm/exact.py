"""Exact dedup by deterministic naming of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed
from cohortspark.session import materialize

BLOCK_BYTES = 2048


def _names(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys``, sorted within shards that share no key, numbered in that order."""
    distinct = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks by name in place of bytes. The bytes are moved once: the way back from the name
    to the block uses a 64-bit hash, unless two different blocks have the same hash."""
    names = materialize(_names(blocks, ["h", "block"]).select("h", "name"), "names")
    clash = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if clash:
        names = materialize(_names(blocks, ["h", "block"]), "names")
        return blocks.join(names, ["h", "block"]).drop("h", "block")
    return blocks.drop("block").join(names, "h").drop("h")


def identities(keyed: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One identity per row of (_key, text): _key, n_blocks, name.

    Texts are equal exactly when (n_blocks, name) are. Level 0 names the blocks of
    ``block_bytes`` bytes; each further level names adjacent pairs of names (the last name of
    an odd row has no partner) and halves the rows, until a document has one name. Equal
    numbers of blocks go through the same levels, so no two different texts can meet.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))
    blocks = keyed.select("_key", n.alias("n_blocks"), F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.withColumn("h", F.xxhash64("block"))
    rows = materialize(_named_blocks(blocks), "level")
    done, length = [], "n_blocks"
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    level = 1
    while True:
        size = F.ceil(F.col(length) / level)
        done.append(rows.filter(size == 1).select("_key", "n_blocks", "name"))
        if longest <= level:
            return reduce(DataFrame.unionByName, done)
        half = F.col("pos") % 2
        pairs = (
            rows.filter(size > 1).groupBy("_key", "n_blocks", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(half == 0, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = materialize(_names(pairs, ["a", "b"]), "names")
        rows = materialize(pairs.join(names, ["a", "b"]).drop("a", "b"), "level")
        level *= 2


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (a null doc_id is the smallest; of
    repeated rows one stays). Null counts as the empty text, and empty texts are equal. An
    empty table gives no rows. Only the columns doc_id and text are read.
    """
    return _dedup(Keyed(docs), block_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _dedup(keyed: Keyed, block_bytes: int) -> DataFrame:
    names = materialize(identities(keyed.frame, block_bytes), "identities")
    groups = names.groupBy("n_blocks", "name").agg(
        F.max("_key").alias("keep_key"), F.count(F.lit(1)).alias("group_size")
    )
    # written, so that Spark can split the rows of a large group in the join that follows
    groups = materialize(keyed.with_doc_id(groups, "keep_key", "keep_id"), "groups")
    found = names.join(groups, ["n_blocks", "name"]).select("_key", "keep_key", "keep_id", "group_size")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256")
    return (
        keyed.frame.select("_key", "doc_id", sha).join(found, "_key")
        .withColumn("kept", F.col("_key") == F.col("keep_key"))
    )


def kept_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns."""
    keyed = Keyed(docs, whole=True)
    names = identities(keyed.frame.select("_key", "text"), block_bytes)
    keep = names.groupBy("n_blocks", "name").agg(F.max("_key").alias("_key"))
    return keyed.rows(materialize(keep.select("_key"), "kept"), "left_semi")
