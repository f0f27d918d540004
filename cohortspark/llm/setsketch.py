"""Near-duplicate documents by SetSketch registers, confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed, Sieve, mix64, raw_texts, runs_of
from cohortspark.llm.components import components
from cohortspark.llm.quality import by_size
from cohortspark.session import materialize

BANDS, ROWS = 40, 5  # a pair with similarity 0.8 shares no band with probability 1.2e-7
REGISTERS = BANDS * ROWS
BASE, RATE, MOST = 1.001, 20.0, (1 << 16) - 2  # b, a and q of the sketch
SURE = 18.0  # a candidate goes if its likelihood at the bound is e^18 times smaller than at its best
BLOCK = 1024  # members of a bucket that are compared at once,
BLOCK_SHINGLES = 1_000_000  # or fewer where their sets are large
COLUMNS = 2048  # shingles that are multiplied at once
PAIRS = 4096  # pairs of sketches that are judged at once
ROWS_AT_ONCE = 512  # members of a block against all of the other one
MULTIPLIERS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words])
    column = np.empty(counts.sum(), dtype=object)
    column[:] = [w for own in words for w in own]
    codes, distinct = pd.factorize(column)
    hashes = mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct)))[codes]
    n = max(0, len(hashes) - size + 1)
    rolled = _rolled(hashes, n, size)
    ends, out = np.cumsum(counts), []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(rolled[end - count : end - size + 1]))
        else:
            out.append(_rolled(hashes[end - count : end], min(1, count), count))
    return out


def _rolled(hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = (total * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[j : j + n]
        total ^= total >> np.uint64(29)
    return mix64(total)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set: floor(1 - log_b of the minimum of exponential values),
    truncated to 0 .. q + 1. The sketch of a union is the maximum of the sketches."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, np.multiply.outer(hashes[i : i + 512], MULTIPLIERS).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, MOST + 1).astype(np.uint16)


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit hash per sketch (row) and band (column)."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        total = mix64(total * np.uint64(65599) + parts[:, :, j])
    return total.view(np.int64)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at_least: float) -> np.ndarray:
    """Whether pairs of sketches (rows) may have similarity ``at_least``, by the joint
    likelihood of larger, smaller and equal registers given the known set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - more - less

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.maximum(u - v * j, 0) * (BASE - 1) / BASE) / np.log(BASE)
        q = -np.log1p(-np.maximum(v - u * j, 0) * (BASE - 1) / BASE) / np.log(BASE)
        tiny = 1e-12
        return more * np.log(p + tiny) + less * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, 0) + tiny)

    grid = np.linspace(0, 1, 41)
    under = np.max([likelihood(np.minimum(j * at_least, top)) for j in grid], axis=0)
    over = np.max([likelihood(np.minimum(at_least + j * (top - at_least), top)) for j in grid], axis=0)
    return (top >= at_least - 1e-9) & (over >= under - SURE)


def sketched(keyed: Keyed, size: int) -> DataFrame:
    """_key, doc_id, n_shingles, d1 and d2 (digest of the set; null where it is empty), sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_of = (s for part in by_size(raw_texts(batch)) for s in shingle_hashes(part, size))
            n, digests, rows = [], [], []
            for s in sets_of:
                n.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() if len(s) else [None, None])
                rows.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), pa.array(rows, pa.binary())],
                ["_key", "doc_id", "n_shingles", "d1", "d2", "sketch"],
            )

    schema = "_key long, doc_id long, n_shingles long, d1 long, d2 long, sketch binary"
    return keyed.frame.select("_key", "doc_id", "text").mapInArrow(sketch, schema)


def _stacked(batch: pa.RecordBatch, column: str) -> np.ndarray:
    joined = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(joined, np.uint16).reshape(-1, REGISTERS)


def bands(sketches: DataFrame, sieve: Sieve | None = None) -> DataFrame:
    """h, _key for every band of every sketch, or only of those the sieve may hold."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            h = band_hashes(_stacked(batch, "sketch"))
            key = np.broadcast_to(keys[:, None], h.shape)
            may = sieve.may_hold(h.ravel()) if sieve else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel()[may]), pa.array(key.ravel()[may])], ["h", "_key"])

    return sketches.select("_key", "sketch").mapInArrow(explode, "h long, _key long")


def _likely(pairs: DataFrame, sketches: DataFrame, at_least: float) -> DataFrame:
    """Of the pairs (a, b) those whose sketches leave the similarity possible."""
    for side in "ab":
        own = sketches.select(F.col("_key").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
        pairs = pairs.join(own.hint("merge"), side)
        if side == "b":
            pairs = pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                part = batch.slice(i, PAIRS)
                n_a, n_b = (part.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
                good = plausible(_stacked(part, "s_a"), _stacked(part, "s_b"), n_a, n_b, at_least)
                yield part.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(judge, "a long, b long")


def full_set(text: bytes, size: int) -> set:
    words = text.lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _held(batch: pa.RecordBatch, wanted: Sieve) -> pa.RecordBatch:
    return batch.filter(pa.array(wanted.may_hold(batch.column("_key").to_numpy(zero_copy_only=False))))


def _texts_of(keys: DataFrame, keyed: Keyed) -> DataFrame:
    """_key, text of the documents whose key a filter made of ``keys`` may hold."""
    wanted = Sieve(keys, "_key")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _held(batch, wanted)

    return keyed.frame.select("_key", "text").mapInArrow(pick, "_key long, text string")


def _confirmed(pairs: DataFrame, keyed: Keyed, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union of their full sets."""
    pairs = materialize(pairs.distinct(), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_key"))
    texts = materialize(_texts_of(ends, keyed), "texts")
    side = lambda c: texts.select(F.col("_key").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()  # rows arrive by a: its set is kept from one row to the next
        for batch in batches:
            good = []
            texts_a, texts_b = raw_texts(batch, "text_a"), raw_texts(batch, "text_b")
            for a, text_a, text_b in zip(batch.column("a").to_pylist(), texts_a, texts_b, strict=True):
                if a != last:
                    last, last_set = a, full_set(text_a, size)
                other = full_set(text_b, size)
                shared = len(last_set & other)
                good.append(100 * shared >= percent * (len(last_set) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long")


PAIR_OF_BLOCKS = ["h", "p", "q"]


def _in_blocks(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, once for each pair of blocks their
    block is part of: h, p, q (the blocks), own (theirs), _key, label, n_shingles, sketch.

    ``members``: h, _key, label. A bucket is cut into blocks by a hash, and every pair of blocks is
    a group of its own, so no bucket is ever in one place as a whole. Pairs within a component are
    not wanted: the component with most members in a large bucket has blocks of its own, which are paired
    with the blocks of all others only. So a bucket with few members outside that component is a
    few copies of each member, however large it is.
    """
    sized = members.join(sketches.select("_key", "n_shingles", "sketch").hint("merge"), "_key")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1))
    labels = sized.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    counts = labels.groupBy("h").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "label", "s")).alias("top"),
    ).filter("labels > 1")
    one = blocks(F.col("n"), F.col("s")) == 1
    counts = counts.select(
        "h", F.when(~one, F.col("top.label")).alias("top"),
        F.when(one, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))).alias("others"),
        F.when(one, 0).otherwise(blocks(F.col("top.n"), F.col("top.s"))).alias("tops"),
    )
    is_top = F.coalesce(F.col("label") == F.col("top"), F.lit(False))
    at = F.xxhash64("_key")
    own = F.when(is_top, F.col("others") + F.pmod(at, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(at, "others"))
    last = F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    rows = sized.join(counts, "h").withColumn("own", own.cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return rows.select(
        "h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "_key", "label", "n_shingles", "sketch"
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*PAIR_OF_BLOCKS).sortWithinPartitions(*PAIR_OF_BLOCKS, "_key")


def _partners(group: pa.Table, at_least: float) -> np.ndarray:
    """Which members of a group have a likely partner in another component there. A pair is
    looked at in the first band it shares only."""
    key, label, own = (group[c].to_numpy() for c in ("_key", "label", "own"))
    p, q, h = (group[c][0].as_py() for c in ("p", "q", "h"))
    n = group["n_shingles"].to_numpy().astype(np.float64)
    s = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    found = np.zeros(len(key), bool)
    right, hashes = np.flatnonzero(own == q), band_hashes(s)
    band = int(np.flatnonzero(hashes[0] == h)[0])
    for left in _in_slices(np.flatnonzero(own == p)):
        small, large = (f(n[left][:, None], n[right][None, :]) for f in (np.minimum, np.maximum))
        pairs = (label[left][:, None] != label[right][None, :]) & (small >= (at_least - 1e-9) * large)
        if p == q:
            pairs &= key[left][:, None] < key[right][None, :]
        for earlier in range(band):
            pairs &= hashes[left, earlier][:, None] != hashes[right, earlier][None, :]
        i, j = np.nonzero(pairs)
        for begin in range(0, len(i), PAIRS):
            a, b = left[i[begin : begin + PAIRS]], right[j[begin : begin + PAIRS]]
            good = plausible(s[a], s[b], n[a], n[b], at_least)
            found[a[good]] = found[b[good]] = True
    return found


def _in_slices(members: np.ndarray) -> list[np.ndarray]:
    return [members[i : i + ROWS_AT_ONCE] for i in range(0, len(members), ROWS_AT_ONCE)]


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of 0/1 matrices."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = often[column] > 1
    number = np.cumsum(often > 1) - 1
    column, owner = number[column[both]], owner[both]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(number[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        other = dense[right].T
        for k, part in enumerate(_in_slices(left)):
            total[k * ROWS_AT_ONCE : (k + 1) * ROWS_AT_ONCE] += dense[part] @ other
    return total


class Forest:
    """Which labels are joined so far, by paths to a root that are halved when they are walked."""

    def __init__(self, labels: np.ndarray):
        self.up = {label: label for label in labels.tolist()}

    def root(self, label: int) -> int:
        up = self.up
        while up[label] != label:
            up[label] = label = up[up[label]]
        return label

    def roots(self, labels: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(labels, return_inverse=True)
        return np.array([self.root(x) for x in distinct.tolist()], labels.dtype)[at]

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _matches(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of a group that join its components as far as any pairs do: a spanning forest, with
    fewer pairs than members, of those that may be linked by their sets of 32-bit hashes. Shingles of one set may
    have equal hashes; two sets share at most as many more shingles as the one with fewer of these
    has, so no link is left out. Pairs that were rejected before (column ``apart``) are not tried again."""
    key, label, own = (group[c].to_numpy() for c in ("_key", "label", "own"))
    apart = {(a, b) for a, others in zip(key.tolist(), group["apart"].to_pylist(), strict=True) for b in others or ()}
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    sets = [np.frombuffer(x, np.uint32) for x in group["hashes"].to_pylist()]
    n = group["n_shingles"].to_numpy()
    equal = n - np.array([len(np.unique(x)) for x in sets])
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    shared = shared_counts(sets, left, right)
    forest, found = Forest(label), []
    for k, part in enumerate(_in_slices(left)):
        both = shared[k * ROWS_AT_ONCE : (k + 1) * ROWS_AT_ONCE] + np.minimum(equal[part][:, None], equal[right][None, :])
        union = n[part][:, None] + n[right][None, :] - both
        may = 100 * both >= percent * union
        for row, i in enumerate(part.tolist()):
            # partners of one member at a time; those it has reached by then are left out at once
            partners = right[may[row] & (label[right] != label[i])]
            if len(partners):
                partners = partners[forest.roots(label[partners]) != forest.root(int(label[i]))]
            for j in partners.tolist():
                pair = (int(min(key[i], key[j])), int(max(key[i], key[j])))
                if pair not in apart and forest.join(int(label[i]), int(label[j])):
                    found.append(pair)
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def _cross_links(
    members: DataFrame, sketches: DataFrame, keyed: Keyed, size: int, percent: int, rejected: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Candidates and links (a, b) between members of one bucket that are in different components.

    The sketches leave out members without a likely partner. The others' sets are compared, all
    of a block with all of another at once, and only a spanning forest leaves the group.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, PAIR_OF_BLOCKS):
            found = group.filter(pa.array(_partners(group, percent / 100))).drop_columns(["sketch"]).combine_chunks()
            yield from found.to_batches()

    rows = _grouped(_in_blocks(members, sketches))
    some = rows.mapInArrow(likely, "h long, p long, q long, own long, _key long, label long, n_shingles long")
    some = materialize(some, "likely")

    wanted = Sieve(some.select("_key").distinct(), "_key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # picks texts and hashes them in one worker; two functions in a row would hold two
        for batch in batches:
            batch = _held(batch, wanted)
            sets = (s for part in by_size(raw_texts(batch)) for s in shingle_hashes(part, size))
            data = pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), data], ["_key", "hashes"])

    sets = materialize(keyed.frame.select("_key", "text").mapInArrow(hashed, "_key long, hashes binary"), "sets")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, PAIR_OF_BLOCKS):
            a, b = _matches(group, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    apart = rejected.groupBy(F.col("a").alias("_key")).agg(F.collect_set("b").alias("apart"))
    held = some.join(sets.hint("merge"), "_key").join(apart, "_key", "left")
    pairs = materialize(_grouped(held).mapInArrow(match, "a long, b long").distinct(), "forest")
    return pairs, materialize(_confirmed(pairs, keyed, size, percent), "links")


def _linked(sketches: DataFrame, keyed: Keyed, size: int, percent: int) -> DataFrame:
    """node, label of all keys in ``sketches`` (one per distinct set) that have a link."""
    at_least = percent / 100
    buckets = bands(sketches).groupBy("h").agg(F.min("_key").alias("a"), F.count(F.lit(1)).alias("n"))
    buckets = materialize(buckets.filter("n > 1").select("h", "a"), "buckets")
    sieve = Sieve(buckets, "h")
    members = materialize(bands(sketches, sieve).join(buckets, "h"), "members")
    # first every member with the smallest of its bucket: as many pairs as members
    stars = members.filter("a <> _key").select("a", F.col("_key").alias("b")).distinct()
    links = materialize(_confirmed(_likely(stars, sketches, at_least), keyed, size, percent), "links")
    labels = materialize(components(links), "labels")
    # then what is in one bucket but not yet in one component
    rejected = links.limit(0)
    while True:
        found = members.select("h", "_key").join(labels.withColumnRenamed("node", "_key"), "_key", "left")
        found = found.withColumn("label", F.coalesce("label", "_key"))
        tried, more = _cross_links(found, sketches, keyed, size, percent, rejected)
        n_tried, n_more = tried.count(), more.count()
        if n_more:
            links = links.union(more)
            labels = materialize(components(links), "labels")
        if n_more == n_tried:
            return labels
        # a pair that looked linked by its short hashes was none, and may have stood for another one in its
        # group: once more without it. Each round rejects at least one more pair.
        rejected = materialize(rejected.union(tried.exceptAll(more)), "rejected")


def _classes(keyed: Keyed, size: int, percent: int) -> DataFrame:
    """_key, doc_id, n_shingles, component (the smallest key reached) of every document."""
    sets = materialize(sketched(keyed, size), "sketches")
    some = sets.filter("n_shingles > 0")
    least = F.min(F.struct("_key", "n_shingles", "sketch")).alias("least")
    distinct = materialize(some.groupBy("d1", "d2").agg(least).select("d1", "d2", "least.*"), "distinct-sets")
    labels = _linked(distinct.drop("d1", "d2"), keyed, size, percent)
    named = distinct.select("d1", "d2", "_key").join(labels.withColumnRenamed("node", "_key"), "_key", "left")
    named = named.select("d1", "d2", F.coalesce("label", "_key").alias("component"))
    joined = sets.drop("sketch").join(named.hint("merge"), ["d1", "d2"], "left")
    return joined.select("_key", "doc_id", "n_shingles", F.coalesce("component", "_key").alias("component"))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of ``size``-word
    shingles (white space between words, A-Z as a-z); component_id is the smallest doc_id that
    is reached over links, and that document is kept. A text of fewer words is one shingle;
    null, empty or blank texts have no shingles, are linked with nothing and kept. Repeated rows have
    equal sets: one of them stays. A null doc_id is larger than any other. Only doc_id and
    text are read; an empty table gives no rows.

    Equal sets are put together first. Candidates share a band of SetSketch registers; those
    whose joint likelihood rules the similarity out go, all others are confirmed on the full
    sets. Each member of a bucket is compared with the bucket's smallest, and members that are
    then still in different components with each other, block by block.
    """
    keyed = Keyed(docs, nulls="last")
    found = _classes(keyed, size, percent).withColumn("kept", F.col("_key") == F.col("component"))
    return keyed.with_doc_id(found, "component", "component_id").select("doc_id", "n_shingles", "component_id", "kept")


def kept_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that near dedup keeps, with all their columns."""
    keyed = Keyed(docs, whole=True, nulls="last")
    keep = _classes(keyed, size, percent).filter("_key = component").select("_key")
    return keyed.rows(materialize(keep, "kept"), "left_semi")
