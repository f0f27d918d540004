"""Periodic runs of words: tiles per octave of periods, boundary Z-functions, stitched intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed, raw_texts
from cohortspark.session import materialize

LEAST_WORDS, LEAST_PERIODS = 24, 3  # a run has at least so many words and so many periods
FIRST = 8  # step of the lowest octave, whose periods are 1 to 2 * FIRST - 1
GROUP = 8  # steps in a tile
PROBE = 8  # words at which a period is tried at most before the Z-functions are computed
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def octaves(n: int) -> list[int]:
    """Steps of the octaves that ``n`` words can have runs in. The octave of step s has the periods s to
    2 * s - 1, the lowest one all shorter periods too."""
    steps, step = [], FIRST
    while n >= LEAST_WORDS and n >= LEAST_PERIODS * (step if step > FIRST else 1):
        steps.append(step)
        step *= 2
    return steps


def likely_boundaries(codes: np.ndarray, step: int) -> np.ndarray:
    """Boundaries r (at word r * step) that a run with a period of this octave may cross.

    A run equals itself, shifted by its period, for at least 2 * step words, so that it crosses two boundaries
    or more. At each of them it goes on for step / 2 words to the right or to the left, so
    boundaries where no period passes the first PROBE of those words are left out.
    """
    n, probe = len(codes), min(PROBE, step // 2)
    low = 1 if step == FIRST else step
    many = n // step if step > FIRST else (n - 1) // step + 1
    wide = 2 * step - low
    behind = np.full(3 * step + PROBE, -1, codes.dtype)
    ahead = np.concatenate([behind[:PROBE], codes, behind])
    here = np.concatenate([behind[:PROBE] - 1, codes, behind - 1])  # another filler: beyond the text nothing is equal
    found = np.zeros(many, bool)
    at = PROBE + step * np.arange(many)
    for side in (range(probe), range(-1, -probe - 1, -1)):
        match = True
        for k in side[:2]:
            # row r, column c: the word that is a period of low + c words after word r * step + k
            shifted = np.ndarray((many, wide), ahead.dtype, ahead, ahead.itemsize * (PROBE + low + k), (ahead.itemsize * step, ahead.itemsize))
            match = match & (shifted == here[at[0] + k :: step][:many, None])
        r, q = np.divmod(np.flatnonzero(match), wide)
        for k in side[2:]:
            if not len(r):
                break
            same = here[at[r] + k] == ahead[at[r] + low + q + k]
            r, q = r[same], q[same]
        found[r] = True
    return np.flatnonzero(found)


def z_function(s: list[int]) -> list[int]:
    """For each position the number of items from there on that equal the beginning of ``s``."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


_PRIMES: dict[int, list[int]] = {}


def smallest_primes(below: int) -> list[int]:
    """The smallest prime factor of each number."""
    if below not in _PRIMES:
        least = np.arange(below)
        for p in range(2, int(below**0.5) + 1):
            if least[p] == p:
                multiples = least[p * p :: p]
                multiples[multiples == np.arange(p * p, below, p)] = p
        _PRIMES[below] = least.tolist()
    return _PRIMES[below]


def fragments_at(words: list[int], t: int, step: int) -> Iterator[tuple[int, int, int]]:
    """Periods of the octave, and from where to where (within ``step`` of ``t``) words equal those a period later.

    Forward and backward Z-functions at the boundary ``t`` give both ends for all periods. Left
    out are stretches shorter than ``step`` and periods that are multiples of one there.
    """
    low, top = (1 if step == FIRST else step), 2 * step
    right = z_function(words[t : t + 3 * step])
    pattern = words[max(0, t - step) : t][::-1]
    stop = min(len(words), t + top - 1)
    left = z_function([*pattern, -3, *words[max(0, t - step) : stop][::-1]])
    base = len(pattern) + 1 + stop - t  # left[base - d]: how far words before t equal those d later
    primes = smallest_primes(top)
    for q in range(low, min(top, stop - t + 1)):
        ahead = min(right[q], step) if q < len(right) else 0
        behind = left[base - q]
        if ahead + behind < step:
            continue
        rest = q
        while rest > 1:
            d = q // primes[rest]
            if left[base - d] >= behind and right[d] >= ahead + q - d:
                break
            rest //= primes[rest]
        else:
            yield q, t - behind, t + ahead


def tile_fragments(words: list[int], begin: int, step: int, boundaries: list[int]) -> list[tuple[int, int, int]]:
    """(period, from, to) of a tile whose first word is word ``begin`` of the text, stitched within the tile."""
    found: dict[int, list[list[int]]] = {}
    for r in boundaries:
        for q, lo, hi in fragments_at(words, r * step - begin, step):
            of_period = found.setdefault(q, [])
            if of_period and begin + lo <= of_period[-1][1]:
                of_period[-1][1] = max(of_period[-1][1], begin + hi)
            else:
                of_period.append([begin + lo, begin + hi])
    return [(q, lo, hi) for q, of_period in found.items() for lo, hi in of_period]


def _tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """step, first word, boundaries (bits) and words of the tiles that runs may cross."""
    for step in octaves(len(codes)):
        crossed = likely_boundaries(codes, step)
        for tile in np.unique(crossed // GROUP).tolist():
            own = crossed[crossed // GROUP == tile] - tile * GROUP
            begin = max(0, (tile * GROUP - 1) * step)
            yield step, begin, int((1 << own).sum()), codes[begin : (tile * GROUP + GROUP + 2) * step]


def _words(batch: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[list[bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
        words = text.split()
        yield rewrite(doc_id, words) if rewrite else words


def _codes(words: list[bytes]) -> np.ndarray:
    column = np.empty(len(words), dtype=object)
    column[:] = words
    return pd.factorize(column)[0].astype(np.int32)


EXPLODED = "_key long, doc_id long, n_words long, sha string, text string, step int, begin long, boundaries int, words binary"
ONE_RUN = "struct<start: long, length: long, period: long>"
RUNS = f"array<{ONE_RUN}>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, top {ONE_RUN}, collapsed_sha256 string, collapsed string"


def stitched(fragments: DataFrame) -> DataFrame:
    """_key, start, length, period of all runs, from pieces of intervals: _key, period, lo, hi.

    Intervals of a document and period that touch are one. They are ordered by a window that holds a
    row at a time, so a document with very many of them needs no memory for them.
    """
    own = Window.partitionBy("_key", "period").orderBy("lo")
    reached = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("lo") > F.col("reached"), F.lit(True)).cast("long")
    island = F.sum(begins).over(own.rowsBetween(Window.unboundedPreceding, 0))
    whole = fragments.withColumn("reached", reached).withColumn("island", island).groupBy("_key", "period", "island")
    length = F.max("hi") - F.min("lo") + F.col("period")
    runs = whole.agg(F.min("lo").alias("start"), length.alias("length"))
    enough = (F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period"))
    return runs.filter(enough).select("_key", "start", "length", "period")


def collapse(words: list[bytes], runs: list[dict]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        change[run["start"] + run["period"]] += 1
        change[run["start"] + run["length"]] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _best(runs: list[dict]) -> dict | None:
    best = None
    for run in runs:  # by start, then period: ties keep the earlier one
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, runs, top, collapsed_sha256 and, with ``texts``, collapsed.

    Words are separated by ASCII white space. A run is a stretch of words with smallest period q (words q
    apart are equal) of at least max(24, 3 * q) words that no neighbour extends. ``runs`` has start, length
    and period of all, by start and then period; ``top`` is the one with the greatest exact length / period
    (ties: first), null without runs; ``collapsed`` has the words that no run holds after its
    first q words, joined by one space, ``collapsed_sha256`` their UTF-8 bytes' SHA-256. ``rewrite`` (doc_id, words) may change the words first.

    Documents are exploded into overlapping tiles of GROUP steps per octave of periods, as far as runs may
    cross them. Tiles are spread over the cluster and solved by themselves; what they find of an
    interval is shuffled by document and period and stitched. Texts without such a tile are not moved.

    Null and empty texts have no words. Rows without doc_id and repeated rows are documents of their own. An empty table
    gives no rows; only doc_id and text are read.
    """
    keyed = Keyed(docs)
    rows = keyed.frame.select("_key", "doc_id", "text")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "doc_id", "n_words", "sha", "text", "step", "begin", "boundaries", "words"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for key, doc_id, words in zip(batch.column("_key").to_pylist(), batch.column("doc_id").to_pylist(), _words(batch, rewrite), strict=True):
                tiles = [(key, None, None, None, None, *tile[:3], tile[3].tobytes()) for tile in _tiles(_codes(words))]
                text = b" ".join(words)
                sha = None if tiles else hashlib.sha256(text).hexdigest()
                out += [(key, doc_id, len(words), sha, text if tiles or texts else None, None, None, None, None), *tiles]
                held += len(text) + sum(len(t[-1]) for t in tiles)
                if held > 1 << 21:
                    yield _as_batch(out, names, types)
                    out, held = [], 0
            yield _as_batch(out, names, types)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, step, begin, bits, words in zip(*(batch.column(c).to_pylist() for c in ("_key", "step", "begin", "boundaries", "words")), strict=True):
                first = -(-begin // step) + (begin > 0)
                own = [first + k for k in range(GROUP) if bits >> k & 1]
                out += [(key, *f) for f in tile_fragments(np.frombuffer(words, np.int32).tolist(), begin, step, own)]
            columns = [np.array(c, np.int64) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_key", "period", "lo", "hi"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "runs", "top", "collapsed_sha256", "collapsed"]
        types = [pa.int64(), pa.int64(), pa.list_(RUN), RUN, pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), batch.column("runs").to_pylist(), strict=True):
                words, runs = text.split(), sorted(runs or [], key=lambda r: (r["start"], r["period"]))
                kept = collapse(words, runs)
                out.append((doc_id, len(words), runs, _best(runs), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield _as_batch(out, names, types)

    exploded = materialize(rows.mapInArrow(explode, EXPLODED), "tiles")
    tiles = exploded.filter("step is not null").select("_key", "step", "begin", "boundaries", "words")
    fragments = tiles.repartition("_key", "step", "begin").mapInArrow(solve, "_key long, period long, lo long, hi long")
    runs = stitched(fragments).groupBy("_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    some = exploded.filter("step is null and sha is null").select("_key", "doc_id", "text")
    some = some.join(materialize(runs, "runs").hint("merge"), "_key", "left").select("doc_id", "text", "runs")
    rest = exploded.filter("sha is not null").select(
        "doc_id", "n_words", F.array().cast(RUNS).alias("runs"), F.lit(None).cast(ONE_RUN).alias("top"),
        F.col("sha").alias("collapsed_sha256"), F.col("text").alias("collapsed"),
    )
    found = rest.union(some.mapInArrow(cut, FOUND))
    return found if texts else found.drop("collapsed")


RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def _as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([x.cast(pa.string(), safe=False) if n in ("text", "collapsed") else x for n, x in zip(names, arrays, strict=True)], names)
