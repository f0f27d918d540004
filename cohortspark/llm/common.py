"""What several operators share: keys of documents, written tables, bounded bit filters, raw texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.filters import quoted
from cohortspark.session import materialize

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Sets the session's Arrow batches to ``most`` bytes where they may be larger: with long
    texts the default of 64 MB is held several times by each worker."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        spark.conf.set(setting, f"{most}b")


class Keyed:
    """Documents with a key of their own, ``_key``, next to ``doc_id`` and ``text``.

    The key is ``doc_id`` itself. Only where an id is missing or used twice does a copy of the
    table get new keys, in the order of ``doc_id`` (rows without one first or last), so that
    the smallest or largest key is also the smallest or largest id.
    """

    def __init__(self, docs: DataFrame, whole: bool = False, nulls: str = "first"):
        """``whole`` adds the row itself as struct ``_row``, whatever its columns are called."""
        small_batches(docs.sparkSession)
        row = [F.struct(*[quoted(c) for c in docs.columns]).alias("_row")] if whole else []
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
        odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1")
        self.plain = odd.limit(1).count() == 0
        if self.plain:
            self.frame = docs.withColumn("_key", F.col("doc_id"))
        else:
            order = F.col("doc_id").asc_nulls_first() if nulls == "first" else F.col("doc_id").asc_nulls_last()
            renewed = docs.orderBy(order).withColumn("_key", F.monotonically_increasing_id())
            self.frame = materialize(renewed, "keyed")

    def rows(self, keys: DataFrame, how: str) -> DataFrame:
        """The rows, as they were given, whose key is (or is not) in column ``_key`` of ``keys``."""
        # one plan at every size; the texts are moved once
        return self.frame.select("_key", "_row").join(keys.hint("merge"), "_key", how).select("_row.*")

    def with_doc_id(self, frame: DataFrame, key: str, name: str) -> DataFrame:
        """``frame`` with the doc_id that belongs to the key in column ``key``, as column ``name``."""
        if self.plain:
            return frame.withColumn(name, F.col(key))
        ids = self.frame.select(F.col("_key").alias(key), F.col("doc_id").alias(name))
        return frame.join(ids, key, "left")


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class Memory[V]:
    """Values of strings: about ``most`` recent ones and as many older ones. When the recent ones are full
    they become the older ones; an older one that returns is recent again, so frequent strings stay."""

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self.recent: dict[str, V] = {}
        self.older: dict[str, V] = {}
        self.long: list[str] = []

    def unknown(self, names: set[str]) -> set[str]:
        """Those of ``names`` that have no value yet; the caller adds one to ``recent``, where the others' are."""
        if len(self.recent) > self.most:
            self.recent, self.older = {}, self.recent
        new = names.difference(self.recent)
        back = [name for name in new if name in self.older]
        self.recent.update((name, self.older[name]) for name in back)
        new.difference_update(back)
        self.long = [name for name in new if len(name) > self.longest]
        return new

    def trim(self) -> None:
        """Forgets the long strings among the last unknown ones."""
        for name in self.long:
            self.recent.pop(name, None)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Sieve:
    """A bit filter of fixed size over 64-bit keys, sent to every worker.

    It never rejects a key it was built from, so what passes is a superset that an exact join
    then settles. Its size is the parameter ``bits`` (a power of two) whatever the input: with
    very many keys it only lets more pass.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 1 << 26):
        spark = keys.sparkSession
        self.shift = 64 - (bits.bit_length() - 1)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = self._places(batch.column(0).to_numpy(zero_copy_only=False))
                word, bit = np.divmod(at, 64)
                bit = np.left_shift(np.int64(1), bit)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])

        words = (
            keys.select(F.col(column).cast("long"))
            .mapInArrow(places, "word long, bit long")
            .groupBy("word")
            .agg(F.expr("bit_or(bit)").alias("bit"))
            .toArrow()
        )
        filled = np.zeros(bits // 64, dtype=np.int64)
        filled[words["word"].to_numpy()] = words["bit"].to_numpy()
        self.words = spark.sparkContext.broadcast(filled)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(self.shift)).astype(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """True where the 64-bit key may be one of the filter's."""
        at = self._places(np.ascontiguousarray(keys))
        return (self.words.value[at >> 6] >> (at & 63)) & 1 == 1


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal ``keys``, a table at a time, from batches sorted by them. A group is held
    as a whole, so the caller bounds its size."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        begins = [0, *np.flatnonzero(new).tolist()]
        for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            key = tuple(c[begin] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)
