"""Removal of long byte strings that occur more than once, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed, Sieve, mix64, raw_texts
from cohortspark.llm.suffix import permuted_lcp, suffix_array
from cohortspark.session import materialize

LENGTH = 200  # bytes of a string that must not occur twice
GRAM = 50  # bytes of an anchor; every string of LENGTH bytes holds the anchor that is its least
PIECE = 1 << 20  # bytes of texts that are looked at together; below 2^24
SHARD_BYTES = 1_500_000  # bytes in a suffix array
LARGE_GROUP = 4000  # regions with one anchor beyond which they do not go to one suffix array
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
MORE_BYTES = mix64(np.arange(1001, 1257, dtype=np.uint64))


class Powers:
    """Powers of FACTOR and of its inverse modulo 2^64, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 1 << 21)
            cls.up, cls.down = (np.full(size, f, np.uint64) for f in (FACTOR, INVERSE))
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)
        return cls.up, cls.down


class Rolling:
    """Hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTES):
        up, self.down = Powers.to(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


class Regions:
    """Strings of ``length`` bytes of some texts, put together by the anchor they share.

    The anchor of a string is the gram with the least hash in it (the first of equals). Adjacent
    strings with one anchor are a region: starts s1 .. s2 and the bytes s1 .. s2 + length. Two equal
    strings have equal anchors at the same place in them, so they are in regions of one anchor.
    """

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        n = len(self.data) - length + 1
        empty = np.empty(0, np.int64)
        self.anchor, self.content, self.s1, self.s2, self.text, self.shift = (empty,) * 6
        self.left, self.right, self.has_left, self.has_right = (empty,) * 4
        self.rolling = None
        if n <= 0:
            return
        self.rolling = Rolling(self.data)
        grams = np.arange(len(self.data) - gram + 1)
        hashes = self.rolling.of(grams, grams + gram)
        mask = np.uint64((1 << 24) - 1)
        least = hashes & ~mask | grams.astype(np.uint64)
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[width - span : width - span + n])
        anchor = (least & mask).astype(np.int64)
        lengths = np.diff(np.concatenate([[0], ends]))
        owner = np.repeat(np.arange(len(ends)), lengths)[:n]
        inside = np.arange(n) + length <= ends[owner]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
        begins = np.flatnonzero(new)
        last = np.append(begins[1:], n) - 1
        good = inside[begins]
        self.s1, self.s2 = begins[good], last[good]
        self.text = owner[self.s1]
        self.shift = -(ends - lengths)[self.text]  # to places in the text
        own_anchor = anchor[self.s1]
        self.anchor = hashes[own_anchor].view(np.int64)
        # a string reaches at least ``half`` bytes to the left or to the right of its anchor
        half = (length - gram) // 2
        near = own_anchor - half
        self.left, self.right = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        self.has_left, self.has_right = self.s1 <= near, self.s2 >= own_anchor - (length - gram - half)
        at = near[self.has_left]
        self.left[self.has_left] = self.rolling.of(at, at + half + gram).view(np.int64)
        at = own_anchor[self.has_right]
        self.right[self.has_right] = self.rolling.of(at, at + half + gram).view(np.int64)
        shape = ((own_anchor - self.s1) << 24 | (self.s2 - self.s1)).astype(np.uint64)
        self.content = mix64(self.rolling.of(self.s1, self.s2 + length) ^ mix64(shape)).view(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts of a batch and their keys, about a piece at a time; longer texts are alone."""
    keys, texts = batch.column("_key").to_numpy(zero_copy_only=False), raw_texts(batch)
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if len(text) > PIECE and begin < i:
            yield texts[begin:i], keys[begin:i]
            begin, size = i, 0
        size += len(text)
        if size >= PIECE or i == len(texts) - 1:
            yield texts[begin : i + 1], keys[begin : i + 1]
            begin, size = i + 1, 0


def _windows(text: bytes, limit: int, length: int) -> Iterator[tuple[int, bytes]]:
    """A long text in stretches of ``limit`` bytes that share length - 1 bytes."""
    for offset in range(0, max(1, len(text) - length + 1), limit):
        yield offset, text[offset : offset + limit + length - 1]


def _regions(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[Regions, np.ndarray, np.ndarray]]:
    """Regions of the texts in a batch with the key of each, and the place of its text."""
    for texts, keys in _parts(batch):
        if len(texts) == 1 and len(texts[0]) > PIECE:
            for offset, part in _windows(texts[0], PIECE, length):
                r = Regions([part], length, gram)
                yield r, keys[r.text], r.shift + offset
        else:
            r = Regions(texts, length, gram)
            yield r, keys[r.text], r.shift


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def anchors(frame: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, n: how many regions of a few megabytes of texts have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, _, _ in _regions(batch, length, gram):
                distinct, n = np.unique(r.anchor, return_counts=True)
                yield _batch("anchor n", distinct, n.astype(np.int64))

    return frame.mapInArrow(count, "anchor long, n long")


def regions(frame: DataFrame, sieve: Sieve, length: int, gram: int) -> DataFrame:
    """anchor, content (hash of the region), left and right (hashes of the anchor with what is next
    to it, null where no string of the region holds that), _key, s1, s2 of the regions whose
    anchor the sieve may hold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, key, shift in _regions(batch, length, gram):
                may = sieve.may_hold(r.anchor)
                left, right = pa.array(r.left[may], mask=r.has_left[may] == 0), pa.array(r.right[may], mask=r.has_right[may] == 0)
                yield _batch("anchor content left right _key s1 s2", r.anchor[may], r.content[may], left, right, key[may],
                             (r.s1 + shift)[may], (r.s2 + shift)[may])

    return frame.mapInArrow(find, "anchor long, content long, left long, right long, _key long, s1 long, s2 long")


def region_bytes(frame: DataFrame, sieve: Sieve, length: int, gram: int) -> DataFrame:
    """anchor, content, bytes of the regions the sieve may hold, each once per few megabytes of texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, _, _ in _regions(batch, length, gram):
                at = np.flatnonzero(sieve.may_hold(r.anchor ^ r.content))
                _, first = np.unique(r.content[at], return_index=True)
                at = at[first]
                data = r.data.tobytes() if len(at) else b""
                cut = [data[a : b + length] for a, b in zip(r.s1[at].tolist(), r.s2[at].tolist(), strict=True)]
                yield _batch("anchor content bytes", r.anchor[at], r.content[at], pa.array(cut, pa.binary()))

    return frame.mapInArrow(find, "anchor long, content long, bytes binary")


def _repeated_starts(table: pa.Table, length: int) -> pa.Table:
    """For the regions of a shard the runs of starts of strings that occur again in the shard."""
    parts = table["bytes"].to_pylist()
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8).astype(np.uint16) + 2
    data[begins + sizes] = 1  # ends a region
    data[-1] = 0
    before, shared = permuted_lcp(data, suffix_array(data, 258))
    again = shared >= length
    hit = again.copy()
    hit[before[again]] = True
    runs = []
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        edge = np.diff(np.concatenate([[False], hit[begin : begin + size - length + 1], [False]]).astype(np.int8))
        runs.append(np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1], axis=1).ravel().tolist())
    out = {"anchor": table["anchor"], "content": table["content"], "runs": pa.array(runs, pa.list_(pa.int64()))}
    return pa.table(out)


def _in_large_groups(frame: DataFrame, large: DataFrame, length: int, gram: int) -> DataFrame:
    """_key, start, end of repeated strings in regions whose anchor has very many contexts.

    Such a group does not fit a suffix array. Its strings are counted one by one, by two 64-bit
    hashes, so that no string's rows meet in one place before they are added up.
    """
    sieve = Sieve(large, "anchor")

    def strings(r: Regions, key: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(sieve.may_hold(r.anchor))
        n = r.s2[at] - r.s1[at] + 1
        which = np.repeat(at, n)
        start = r.s1[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        if not len(start):
            return (np.empty(0, np.int64),) * 4
        second = Rolling(r.data, MORE_BYTES)
        return r.rolling.of(start, start + length).view(np.int64), second.of(start, start + length).view(np.int64), key[which], start + shift[which]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, key, shift in _regions(batch, length, gram):
                g1, g2, _, _ = strings(r, key, shift)
                both, n = np.unique(np.stack([g1, g2], axis=1), axis=0, return_counts=True)
                yield _batch("g1 g2 n", np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), n.astype(np.int64))

    counted = frame.mapInArrow(count, "g1 long, g2 long, n long").groupBy("g1", "g2").agg(F.sum("n").alias("n"))
    repeated = materialize(counted.filter("n > 1").select("g1", "g2"), "strings")
    again = Sieve(repeated, "g1")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, key, shift in _regions(batch, length, gram):
                g1, g2, owner, start = strings(r, key, shift)
                may = again.may_hold(g1)
                yield _batch("g1 g2 _key start", g1[may], g2[may], owner[may], start[may])

    found = frame.mapInArrow(places, "g1 long, g2 long, _key long, start long").join(repeated, ["g1", "g2"], "left_semi")
    return found.select("_key", "start", (F.col("start") + length).alias("end"))


def repeated_spans(frame: DataFrame, length: int = LENGTH, gram: int = GRAM, large_group: int = LARGE_GROUP) -> DataFrame:
    """_key, start, end (bytes) of strings of at least ``length`` bytes that occur again; they may overlap.

    1. Anchors that occur once in all texts are left out.
    2. Regions with equal anchor and bytes are counted together: all strings of a region that
       occurs twice are repeated.
    3. Different regions of one anchor can only share a string if they share what is on one side
       of it. Those that do go to shards by anchor, one copy of each. A shard's suffix array
       gives the strings that occur in more than one of them.
    """
    counted = anchors(frame, length, gram).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    sieve = Sieve(materialize(counted, "anchors"), "anchor")
    found = materialize(regions(frame, sieve, length, gram), "regions")
    kinds = found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("right").alias("right")
    )
    kinds = materialize(kinds, "kinds")
    sides = [F.struct(F.lit(i).alias("side"), F.col(c).alias("h")) for i, c in enumerate(("left", "right"))]
    sides = kinds.select("anchor", "content", "n", F.inline(F.array(*sides))).filter("h is not null")
    shared = sides.groupBy("anchor", "side", "h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    related = sides.join(shared, ["anchor", "side", "h"], "left_semi").groupBy("anchor", "content").agg(F.first("n").alias("n"))
    related = materialize(related, "related")
    groups = related.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    large = materialize(groups.filter(F.col("kinds") > large_group).select("anchor"), "large")
    # kinds that occur twice are repeated throughout, but others may share strings with them
    wanted = related.join(large, "anchor", "left_anti")
    mixed = materialize(wanted.filter("n = 1").select("anchor", "content"), "mixed")
    chosen = Sieve(wanted.select(F.col("anchor").bitwiseXOR(F.col("content")).alias("x")), "x")
    cut = region_bytes(frame, chosen, length, gram).groupBy("anchor", "content").agg(F.first("bytes").alias("bytes"))
    cut = materialize(cut, "region-bytes")
    size = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-size // SHARD_BYTES)))).alias("shard")
    runs = cut.select(shard, "*").groupBy("shard").applyInArrow(
        lambda table: _repeated_starts(table, length), "anchor long, content long, runs array<long>"
    )
    runs = materialize(runs.filter(F.size("runs") > 0).join(mixed, ["anchor", "content"], "left_semi"), "runs")
    whole = kinds.filter("n > 1").select("anchor", "content", F.lit(None).cast("array<long>").alias("runs"))
    verdict = runs.unionByName(whole)
    marked = found.join(verdict, ["anchor", "content"])
    steps = F.coalesce(F.col("runs"), F.array(F.lit(0).cast("long"), F.col("s2") - F.col("s1")))
    count = (F.size(steps) / 2).cast("int")
    pair = F.explode(F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get(steps, i * 2).alias("a"), F.get(steps, i * 2 + 1).alias("b"))
    ))
    spans = marked.select("_key", "s1", pair.alias("p"))
    spans = spans.select("_key", (F.col("s1") + F.col("p.a")).alias("start"), (F.col("s1") + F.col("p.b") + length).alias("end"))
    if large.limit(1).count():
        spans = spans.unionByName(_in_large_groups(frame, large, length, gram))
    return spans


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that some spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), ends[np.append(first[1:], len(starts)) - 1].tolist(), strict=True))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large_group: int = LARGE_GROUP, texts: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``,
    kept (the remaining bytes).

    Every byte is removed that a string of ``length`` bytes covers which also starts anywhere else, in
    the same document or another; overlaps count and all is judged on the input. Texts are
    UTF-8 bytes and no string crosses from one to the next. Null counts as empty; texts
    shorter than ``length`` stay; of repeated rows all are removed. An empty table gives no
    rows. Only doc_id and text are read.
    """
    keyed = Keyed(docs)
    frame = keyed.frame.select("_key", "text")
    spans = repeated_spans(frame, length, gram, large_group)
    spans = spans.groupBy("_key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    spans = materialize(spans, "spans")
    sieve = Sieve(spans, "_key")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text goes on to the join only if bytes of it may go
        for batch in batches:
            data = raw_texts(batch)
            may = sieve.may_hold(batch.column("_key").to_numpy(zero_copy_only=False)).tolist()
            both = list(zip(data, may, strict=True))
            sha = [None if m else hashlib.sha256(t).hexdigest() for t, m in both]
            kept = [t if texts and not m else None for t, m in both]
            yield _batch("_key doc_id n_bytes kept_sha256 kept text", batch.column("_key"), batch.column("doc_id"),
                         pa.array([len(t) for t in data], pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()),
                         pa.array([t if m else None for t, m in both], pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans = [], []
            sha, kept = batch.column("kept_sha256").to_pylist(), batch.column("kept").to_pylist()
            columns = (batch.column(c).to_pylist() for c in ("text", "starts", "ends"))
            for i, (text, starts, ends) in enumerate(zip(*columns, strict=True)):
                runs = merged(np.array(starts, np.int64), np.array(ends, np.int64)) if starts else []
                removed.append(sum(b - a for a, b in runs))
                n_spans.append(len(runs))
                if sha[i] is None:
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    sha[i] = hashlib.sha256(rest).hexdigest()
                    kept[i] = rest if texts else None
            yield _batch("doc_id n_bytes n_removed n_spans kept_sha256 kept", batch.column("doc_id"), batch.column("n_bytes"),
                         pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()),
                         pa.array(kept, pa.binary()))

    result = (
        keyed.frame.select("_key", "doc_id", "text")
        .mapInArrow(part, "_key long, doc_id long, n_bytes long, kept_sha256 string, kept binary, text binary")
        .join(spans.hint("merge"), "_key", "left")
        .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
    return result if texts else result.drop("kept")
