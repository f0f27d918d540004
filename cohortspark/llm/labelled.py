"""Bounded samples of labelled documents for training classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from cohortspark.llm.common import raw_texts, small_batches


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(modulus))


def excerpt(text: bytes, pieces: int, size: int) -> bytes:
    """The whole text, or ``pieces`` slices evenly spread over it when it is longer than they are."""
    if len(text) <= pieces * size:
        return text
    starts = np.linspace(0, len(text) - size, pieces).astype(int)
    return b"\n".join(text[s : s + size] for s in starts)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
    rows: dict[int, int], pieces: int, size: int,
) -> tuple[list[bytes], np.ndarray]:
    """Training texts and their labels, collected to the driver.

    At most ``rows[k]`` rows of class k, picked by a hash of doc_id among the labelled ids whose
    remainder is not ``held_out``; of each text at most ``pieces`` slices of ``size`` bytes. The
    sample is thus bounded whatever the input. Null ids or labels are never learned from.
    """
    small_batches(docs.sparkSession)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.filter(remainder(F.col("doc_id"), modulus) != held_out)
    picked = None
    for k, n in rows.items():
        part = ids.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([excerpt(t, pieces, size) for t in raw_texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), parts], ["doc_id", "label", "part"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    got = (
        found.select("doc_id", "label", "text").mapInArrow(cut, "doc_id long, label int, part binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "part").limit(sum(rows.values())).toArrow()
    )
    return got["part"].to_pylist(), got["label"].to_numpy().astype(np.float64)
