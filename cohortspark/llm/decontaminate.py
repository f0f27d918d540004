"""Benchmark decontamination on text templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed, Sieve, mix64, raw_texts
from cohortspark.llm.quality import by_size
from cohortspark.session import materialize

WINDOW = 8  # words
LEAST_WORDS = 13  # words of an item in a row of windows that make a document a leak
SHORTEST = 5  # items with fewer words cannot be told from ordinary text and are matched with whole texts only
SALTS = 32  # parts of the windows that are placeholders only: a table of numbers has very many equal ones
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMBER = re.compile(rb"[0-9][0-9.,:/]*")
NUMBER_UNIT = re.compile(rb"[0-9][0-9.,]*([a-z]{1,5})")
# fixed values: units as they are written after a number
UNITS = frozenset(
    b"mm cm m km in ft yd mi miles meters metres kilometers kilometres mg g kg lb lbs oz pounds grams kilograms ml l litres "
    b"liters gallons s sec seconds min minutes h hr hours days weeks months years c f k degrees percent pct usd eur gbp "
    b"dollars cents euros pounds w kw kwh hz khz mhz ghz b kb mb gb tb v a mph kmh".split()
)
PLAIN, NUM, UNIT, CAPITAL, BOTH = range(5)
# ways to set placeholders: none, numbers and units, names inside sentences too, all capitalised words too
NONE, VALUES, INNER, ALL = range(4)
SLOT_NAMES = {NUM: "num", UNIT: "unit", CAPITAL: "name", BOTH: "num_unit"}


def _word(raw: bytes) -> tuple[bytes, int, bool]:
    """The bare lower-case word, its kind, and whether it ends a sentence."""
    bare = raw.strip(EDGES)
    lower = bare.lower()
    ends = raw.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":")
    if bare[:1].isdigit():
        if NUMBER.fullmatch(lower):
            return lower, NUM, ends
        both = NUMBER_UNIT.fullmatch(lower)
        return lower, BOTH if both and both[1] in UNITS else PLAIN, ends
    if lower in UNITS:
        return lower, UNIT, ends
    return lower, CAPITAL if bare[:1].isupper() and bare[1:].islower() else PLAIN, ends


class Templates:
    """Words of some texts as hashes, once with placeholders and once as they are."""

    def __init__(self, texts: list[bytes]):
        raw: list[bytes] = []
        counts, line_starts = [], []
        for text in texts:
            before = len(raw)
            for line in text.split(b"\n"):
                line_starts.append(len(raw))
                raw += line.split()
            counts.append(len(raw) - before)
        column = np.empty(len(raw), dtype=object)
        column[:] = raw
        codes, distinct = pd.factorize(column) if raw else (np.empty(0, np.int64), [])
        known = [_word(w) for w in distinct]
        self.words = [w for w, _, _ in known]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(known))
        kinds = np.fromiter((k for _, k, _ in known), np.int8, len(known))
        ends = np.fromiter((e for _, _, e in known), bool, len(known))
        empty = np.fromiter((not w for w in self.words), bool, len(known))
        doc = np.repeat(np.arange(len(texts)), counts)
        start = np.zeros(len(raw) + 1, bool)
        start[line_starts] = True
        start = start[:-1]
        if len(raw):
            start[1:] |= ends[codes[:-1]]
        keep = ~empty[codes] if len(raw) else np.empty(0, bool)
        self.codes, self.doc = codes[keep], doc[keep]
        kind = kinds[self.codes]
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = (kind[:-1] == NUM) & (self.doc[1:] == self.doc[:-1])
        kind[(kind == UNIT) & ~after_number] = PLAIN
        capital = kind == CAPITAL
        self.kinds = [np.full(len(kind), PLAIN, np.int8), np.where(capital, PLAIN, kind).astype(np.int8),
                      np.where(capital & start[keep], PLAIN, kind).astype(np.int8), kind]
        self.plain = mix64(hashes[self.codes])
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def windows(self, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts (in all words) of the windows of ``size`` words within one text, and their hashes
        under each of ``kinds``."""
        n = len(self.codes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), [np.empty(0, np.int64) for _ in self.kinds]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        hashes = []
        for kind in self.kinds:
            word = np.where(kind == PLAIN, self.plain, mix64(kind.astype(np.uint64) + np.uint64(1)))
            total = np.full(n, size, np.uint64)
            for j in range(size):
                total = (total * np.uint64(0x9E3779B97F4A7C15)) ^ word[j : j + n]
                total ^= total >> np.uint64(29)
            hashes.append(total[at].view(np.int64))
        return at, hashes

    def slots(self, kind: np.ndarray, start: int, size: int) -> list[str]:
        """Values that placeholders of a window stand for under one of ``kinds``, as kind=value."""
        return [
            f"{SLOT_NAMES[int(k)]}={self.words[c].decode('utf-8', 'replace')}"
            for k, c in zip(kind[start : start + size], self.codes[start : start + size], strict=True) if k != PLAIN
        ]


def template_windows(
    frame: DataFrame, key: str, sizes: list[int] | None, sieve: Sieve | None = None, shortest: int = SHORTEST
) -> DataFrame:
    """Windows of the texts in ``frame``: key, pos (word), n_words (of the text), size, h, ways, slots.

    A window has a row for each different hash it has under the ways to set placeholders
    (``Templates.kinds``); bit i of ``ways`` is set if way i gives this hash. ``sizes`` None: of
    WINDOW words, or the whole text where it is shorter. Windows of fewer than ``shortest`` words are
    whole texts, word by word. With a sieve only windows that it may hold are returned.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done = batch.column(0).to_numpy(zero_copy_only=False), 0
            for part in by_size(raw_texts(batch)):
                t = Templates(part)
                out: dict[str, list] = {"key": [], "pos": [], "n_words": [], "size": [], "h": [], "ways": [], "slots": []}
                for size in sizes or range(1, WINDOW + 1):
                    every, hashes = t.windows(size)
                    good, whole = np.ones(len(every), bool), size < shortest
                    if whole or (sizes is None and size < WINDOW):
                        good = t.counts[t.doc[every]] == size
                    for way, kind in enumerate(t.kinds[:1] if whole else t.kinds):
                        new = good.copy()
                        for before in hashes[:way]:
                            new &= hashes[way] != before
                        new = np.flatnonzero(new)
                        if sieve is not None:
                            new = new[sieve.may_hold(hashes[way][new])]
                        at, h = every[new], hashes[way][new]
                        doc = t.doc[at]
                        out["key"].append(keys[done + doc])
                        out["pos"].append((at - t.first[doc]).astype(np.int32))
                        out["n_words"].append(t.counts[doc].astype(np.int32))
                        out["size"].append(np.full(len(at), size, np.int32))
                        out["h"].append(h)
                        out["ways"].append(sum((x[new] == h).astype(np.int32) << i for i, x in enumerate(hashes)))
                        out["slots"] += [t.slots(kind, i, size) for i in at.tolist()]
                done += len(part)
                columns = [pa.array(np.concatenate(out[c])) for c in ("key", "pos", "n_words", "size", "h", "ways")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out["slots"], pa.list_(pa.string()))], list(out))

    schema = "key long, pos int, n_words int, size int, h long, ways int, slots array<string>"
    return frame.select(key, "text").mapInArrow(cut, schema).withColumnRenamed("key", key)


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Pairs of a document and a benchmark item whose passage it holds.

    Returns doc_id, item_id, matched_windows, item_windows, share (of the item's windows),
    same_values (no number, name or unit was changed). Both sides are cut into words without
    punctuation, in lower case; numbers, units behind numbers and capitalised words inside a
    sentence become typed placeholders. Windows of WINDOW words are joined by hash: with these
    placeholders, however many; with those of numbers and units only and word by word, which do
    not depend on case or line breaks; and with all capitalised words as names, so that names at
    the start of a sentence or line are found too. What matches in any way counts. Along one
    alignment of document and item, every value of the item must always be replaced by the same
    value; where it is not, only windows with unchanged values count (first words of sentences
    are values only where they are matched as such). A pair is returned if
    the matched windows make up LEAST_WORDS words, or the whole item where it is shorter. A window of
    the document counts for one window of the item only, so that a few numbers in a row
    are not taken for a long row of them.
    Items of fewer than ``shortest`` words match documents that have the same words and no others. Null and
    empty texts match nothing; repeated rows are items and documents of their own. No pair is
    dropped; documents without a match have no row.
    """
    return _pairs(Keyed(docs), benchmark, shortest).select(
        "doc_id", "item_id", "matched_windows", "item_windows", "share", "same_values"
    )


def _needed() -> Column:
    """How many different windows of an item a document must match."""
    return F.least(F.col("item_windows"), F.greatest(F.lit(1), LEAST_WORDS - F.col("size") + 1))


def _probes(windows: DataFrame, found: DataFrame) -> DataFrame:
    """The windows of each item at its (windows - needed + 1) places that fewest documents have.

    Whoever matches as many places as needed matches one of these, so a window that very many items and
    documents share, an instruction for example, is not joined as long as it makes no leak by itself.
    """
    often = found.groupBy("h", "size").agg(F.count(F.lit(1)).alias("often"))
    places = windows.join(often, ["h", "size"], "left").groupBy("_item", "item_pos").agg(
        F.sum(F.coalesce("often", F.lit(0))).alias("often"),
        F.first("item_windows").alias("item_windows"), F.first("size").alias("size"),
    )
    rank = F.row_number().over(Window.partitionBy("_item").orderBy("often", "item_pos"))
    places = places.withColumn("rank", rank).filter(F.col("rank") <= F.col("item_windows") - _needed() + 1)
    return windows.join(places.filter("often > 0").select("_item", "item_pos"), ["_item", "item_pos"], "left_semi")


def _candidates(windows: DataFrame, found: DataFrame) -> DataFrame:
    """_key, _item of all pairs that match in one of the item's probed windows."""
    full = lambda slots: F.size(slots) == F.col("size")
    salts = F.when(full("item_slots"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(full("slots"), F.pmod(F.hash("_key", "pos"), F.lit(SALTS))).otherwise(F.lit(0))
    probes = _probes(windows, found).select("_item", "h", "size", F.explode(salts).alias("salt"))
    joined = found.select("_key", "h", "size", salt.alias("salt")).join(probes, ["h", "size", "salt"])
    return joined.select("_key", "_item").distinct()


def _pairs(keyed: Keyed, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = materialize(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    windows = template_windows(items, "_item", None, shortest=shortest)
    windows = materialize(
        windows.withColumn("item_windows", F.col("n_words") - F.col("size") + 1)
        .withColumnsRenamed({"pos": "item_pos", "slots": "item_slots", "ways": "item_ways"}).drop("n_words"), "item-windows",
    )
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [WINDOW]
    sieve = Sieve(windows, "h", bits=1 << 24)
    found = materialize(template_windows(keyed.frame, "_key", sizes, sieve, shortest).drop("n_words"), "found-windows")
    # all windows of the items that a document may hold meet the document's own
    candidates = materialize(_candidates(windows, found), "candidates")
    matches = candidates.join(windows, "_item").join(found, ["_key", "h", "size"])
    # a window may match in several ways; names are to agree among the matches of one way, numbers among all
    ways = [(VALUES, VALUES), (INNER, INNER), (INNER, ALL), (ALL, INNER), (ALL, ALL)]
    both = {(i, j): (F.getbit("item_ways", F.lit(i)) + F.getbit("ways", F.lit(j))) == 2 for i, j in ways}
    zipped = F.arrays_zip("item_slots", "slots")
    numbers = F.filter(zipped, lambda x: ~x.item_slots.startswith("name="))
    distinct = lambda x: F.array_distinct(F.flatten(F.collect_set(x)))
    line = matches.groupBy("_key", "_item", (F.col("pos") - F.col("item_pos")).alias("line")).agg(
        F.collect_set(F.when(F.col("slots") == F.col("item_slots"), F.col("item_pos"))).alias("same_at"),
        *(F.collect_set(F.when(b, F.col("item_pos"))).alias(f"at_{i}_{j}") for (i, j), b in both.items()),
        *(distinct(F.when(b, zipped)).alias(f"values_{i}_{j}") for (i, j), b in both.items()),
        distinct(numbers).alias("numbers"),
        F.first("item_windows").alias("item_windows"), F.first("size").alias("size"),
    )
    consistent = lambda v: F.size(v) == F.size(F.array_distinct(F.col(f"{v}.item_slots")))
    all_same = consistent("numbers") & consistent(f"values_{INNER}_{INNER}")
    none = F.array().cast("array<int>")
    at = [F.when(all_same & consistent(f"values_{i}_{j}"), F.col(f"at_{i}_{j}")).otherwise(none) for i, j in both]
    line = line.withColumn("at", F.array_distinct(F.concat("same_at", *at)))
    moved = lambda c: F.transform(c, lambda x: x + F.col("line"))
    line = line.withColumns({"doc_at": moved("at"), "doc_same": moved("same_at")})
    number = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    pairs = line.groupBy("_key", "_item").agg(
        F.least(number("at"), number("doc_at")).alias("matched_windows"),
        (number("doc_at") == number("doc_same")).alias("same_values"),
        F.first("item_windows").alias("item_windows"), F.first("size").alias("size"),
    )
    pairs = pairs.filter(F.col("matched_windows") >= _needed()).join(items.select("_item", "item_id"), "_item")
    pairs = keyed.with_doc_id(pairs, "_key", "doc_id")
    return pairs.withColumn("share", F.col("matched_windows") / F.col("item_windows"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    keyed = Keyed(docs, whole=True)
    return keyed.rows(materialize(_pairs(keyed, benchmark).select("_key").distinct(), "leaks"), "left_anti")
