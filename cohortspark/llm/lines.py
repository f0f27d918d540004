"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed, Sieve, raw_texts
from cohortspark.session import materialize

HASH = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case (both ASCII only)."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """128-bit hashes of line keys and in how many documents of a batch of rows each is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in raw_texts(batch):
                keys = {line_key(line) for line in text.split(b"\n")}
                seen.update(xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, min_chars))
            h1, h2 = _halves(list(seen))
            n = pa.array(np.fromiter(seen.values(), np.int64, len(seen)))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), n], ["h1", "h2", "n"])

    return docs.select("text").mapInArrow(count, "h1 long, h2 long, n long")


class LineRuns:
    """Runs of (hash, documents), each sorted by hash and written once.

    A new batch adds a run to level 0. When a level holds ``fanout`` runs they are merged to
    one run of the next level, so a key is rewritten once per level. A key that has reached
    ``min_docs`` documents, in one batch or in a merge, moves to the settled runs; every later
    batch is merge-anti-joined with those and no longer carries it.
    """

    def __init__(self, min_docs: int, fanout: int = 4):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def add(self, counts: DataFrame) -> None:
        """``counts``: rows of h1, h2, n from documents that were not added before."""
        fresh = counts.groupBy(*HASH).agg(F.sum("n").alias("n"))
        if self.settled:
            fresh = fresh.join(self._settled().hint("merge"), HASH, "left_anti")
        self._settle(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _settled(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.settled).distinct()

    def _compact(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self._merged(self.levels[level])
        self.levels[level] = []
        self._settle(merged, level + 1)

    def _settle(self, counts: DataFrame, level: int) -> None:
        """Writes a run sorted by hash; its frequent keys are settled, the others make the level's run."""
        run = materialize(counts.sortWithinPartitions(*HASH), "run")
        self.settled.append(run.filter(F.col("n") >= self.min_docs).select(*HASH))
        self.levels[level].append(run.filter(F.col("n") < self.min_docs))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """h1, h2 of all keys that are in at least ``min_docs`` documents."""
        runs = [run for level in self.levels for run in level]
        found = list(self.settled)
        if runs:
            found.append(self._merged(runs).filter(F.col("n") >= self.min_docs).select(*HASH))
        return materialize(reduce(DataFrame.unionByName, found).distinct(), "frequent")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, texts: bool = False) -> DataFrame:
    """Drops every line whose key is in at least ``min_docs`` documents, from all documents.

    Returns one row per document: doc_id, n_lines, n_dropped, kept_sha256 and, with ``texts``,
    kept_text. Texts are split at line feeds; null or empty text is one empty line, and keys
    with fewer than ``min_chars`` code points stay. Repeated rows count as documents of their
    own. Rows are added to the runs in ``batches`` parts by a hash of their key, as batches
    of a growing corpus would be. An empty table gives no rows; other columns are not read.
    """
    keyed = Keyed(docs)
    runs = LineRuns(min_docs)
    part = F.pmod(F.xxhash64("_key"), F.lit(batches))
    for i in range(batches):
        runs.add(line_counts(keyed.frame.filter(part == i), min_chars))
    frequent = runs.frequent()
    lines_sieve = Sieve(frequent, "h1")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            digests, row, pos = [], [], []
            for i, text in enumerate(raw_texts(batch)):
                for j, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        pos.append(j)
            h1, h2 = _halves(digests)
            may = lines_sieve.may_hold(h1)
            arrays = keys[np.asarray(row, np.int64)[may]], np.asarray(pos, np.int32)[may], h1[may], h2[may]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["_key", "pos", "h1", "h2"])

    found = keyed.frame.select("_key", "text").mapInArrow(hits, "_key long, pos int, h1 long, h2 long")
    drops = found.join(frequent, HASH, "left_semi").groupBy("_key").agg(F.collect_list("pos").alias("drop"))
    drops = materialize(drops, "drops")
    keys_sieve = Sieve(drops, "_key")
    schema = "_key long, doc_id long, n_lines long, kept_sha256 string, kept_text string, text string"

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text goes on to the join only if lines of it may be dropped
        for batch in batches:
            data = raw_texts(batch)
            may = keys_sieve.may_hold(batch.column("_key").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([
                batch.column("_key"), batch.column("doc_id"),
                pa.array([t.count(b"\n") + 1 for t in data], pa.int64()),
                pa.array([None if m else hashlib.sha256(t).hexdigest() for t, m in zip(data, may, strict=True)], pa.string()),
                pa.array([t if texts and not m else None for t, m in zip(data, may, strict=True)], pa.binary()).cast(pa.string()),
                pa.array([t if m else None for t, m in zip(data, may, strict=True)], pa.binary()).cast(pa.string()),
            ], ["_key", "doc_id", "n_lines", "kept_sha256", "kept_text", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped = [set(x or ()) for x in batch.column("drop").to_pylist()]
            sha, kept = batch.column("kept_sha256").to_pylist(), batch.column("kept_text").to_pylist()
            for i, text in enumerate(raw_texts(batch)):
                if sha[i] is None:
                    rest = b"\n".join(x for j, x in enumerate(text.split(b"\n")) if j not in dropped[i])
                    sha[i] = hashlib.sha256(rest).hexdigest()
                    kept[i] = rest.decode() if texts else None
            n = pa.array([len(x) for x in dropped], pa.int64())
            arrays = [batch.column("doc_id"), batch.column("n_lines"), n, pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    result = (
        keyed.frame.select("_key", "doc_id", "text").mapInArrow(untouched, schema)
        .join(drops.hint("merge"), "_key", "left")  # one plan at every size
        .mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    )
    return result if texts else result.drop("kept_text")
