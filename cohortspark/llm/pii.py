"""Personal data: fixed patterns, and contexts learned from what they find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Keyed, Sieve, mix64, raw_texts
from cohortspark.llm.quality import by_size
from cohortspark.session import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# not behind a digit: a match cannot begin inside a run of digits whose start fails
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
HINT = re.compile(r"[0-9@]|\[at\]|\(at\)")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
AROUND = 400  # characters in which the two words before a mention are looked for first
TABLES = 8  # of learned values, one a round, before they become one table
LEAST_CHARS = 6  # of a token that may be an identifier


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping. Linear: what can precede an @ ends at the one before it."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def context(text: str, start: int) -> int | None:
    """Hash of the two words before the token that begins at ``start``; None where there are
    not two, or where letters or digits stand directly before it."""
    wide = AROUND
    while True:
        low = max(0, start - wide)
        before = text[low:start]
        glued = TOKEN.search(before[::-1])
        if glued and glued.start() == 0:
            if glued.group().strip(EDGES):
                return None
            before = before[: len(before) - glued.end()]
        words = [m for m in TOKEN.finditer(before)][-2:]
        if len(words) == 2 and (low == 0 or words[0].start() > 0):
            return pair_hash(*(bare_hash(w.group().encode()) for w in words))
        if low == 0:
            return None
        wide *= 2  # a long word or much white space


def bare_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word.strip(EDGES.encode()).lower())


def pair_hash(first: int, second: int) -> int:
    return int(pair_hashes(np.array([first], np.uint64), np.array([second], np.uint64))[0])


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) ^ second).view(np.int64)


def mentions(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int | None, int]]]:
    """Base spans, and all mentions (kind or -1, start, end, context, value): the base spans
    and every other token that looks like an identifier."""
    if not HINT.search(text):
        return [], []
    base = base_spans(text)
    out = [(k, a, b, context(text, a), _value(text[a:b])) for k, a, b in base]
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    for m in TOKEN.finditer(text):
        token = m.group()
        if HINT.search(token):
            bare = token.strip(EDGES)
            start = m.start() + (token.index(bare) if bare else 0)
            if len(bare) >= LEAST_CHARS and not taken[start : start + len(bare)].any():
                out.append((-1, start, start + len(bare), context(text, start), _value(bare)))
    return base, out


def _value(text: str) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(text.lower())).astype(np.int64).item()


def _found(keyed: Keyed) -> DataFrame:
    """Per document: base (kind, start, end) and mentions, as arrays."""
    span = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    mention = pa.struct([*span, ("context", pa.int64()), ("value", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [mentions(t or "") for t in batch.column("text").to_pylist()]
            spans = pa.array([[dict(zip(("kind", "s", "e"), x, strict=True)) for x in b] for b, _ in both], pa.list_(span))
            every = [[dict(zip(("kind", "s", "e", "context", "value"), x, strict=True)) for x in m] for _, m in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("doc_id"), spans, pa.array(every, pa.list_(mention))],
                ["_key", "doc_id", "base", "mentions"],
            )

    schema = (
        "_key long, doc_id long, base array<struct<kind:int,s:int,e:int>>, "
        "mentions array<struct<kind:int,s:int,e:int,context:long,value:long>>"
    )
    return keyed.frame.select("_key", "doc_id", "text").mapInArrow(scan, schema)


def context_totals(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each of the given contexts is followed by any word at all: context, total."""
    sieve = Sieve(contexts, "context", bits=1 << 24)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(raw_texts(batch)):
                words = [t.split() for t in part]
                flat = [w for own in words for w in own]
                column = np.empty(len(flat), dtype=object)
                column[:] = flat
                codes, distinct = pd.factorize(column)
                hashes = np.fromiter((bare_hash(w) for w in distinct), np.uint64, len(distinct))[codes]
                doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
                pairs = pair_hashes(hashes[:-2], hashes[1:-1])[doc[:-2] == doc[2:]]
                seen, n = np.unique(pairs[sieve.may_hold(pairs)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n.astype(np.int64))], ["context", "n"])

    counted = docs.select("text").mapInArrow(count, "context long, n long")
    return counted.groupBy("context").agg(F.sum("n").alias("total")).join(contexts, "context", "left_semi")


def learned(graph: DataFrame, totals: DataFrame, least_seeds: int, confidence: float) -> DataFrame:
    """Values that patterns vouch for: value, kind.

    ``graph``: kind (-1: not known), context, value, n (mentions). In each round a
    context is trusted for a kind if at least ``least_seeds`` different values of that kind
    stand in it and they are at least ``confidence`` of all that follows it; unknown values in a
    trusted context take its kind (the most confident one) and are seeds of the next round.
    Ends when a round finds nothing new, as it must: each adds at least one of finitely many values.
    """
    known = graph.filter("kind >= 0").select("value", "kind").distinct()
    added: list[DataFrame] = []
    while True:
        seeds = reduce(DataFrame.unionByName, [known, *added]).select("value", F.col("kind").alias("seed")).distinct()
        hits = graph.join(seeds, "value").groupBy("context", "seed").agg(
            F.sum("n").alias("hits"), F.count_distinct("value").alias("values")
        )
        share = F.col("hits") / F.greatest("total", "hits")
        trusted = hits.join(totals, "context").withColumn("trust", share).filter(
            (F.col("values") >= least_seeds) & (F.col("trust") >= confidence)
        )
        candidates = graph.filter("kind < 0").join(trusted, "context").groupBy("value").agg(
            F.max(F.struct("trust", -F.col("seed"))).alias("best")
        )
        new = candidates.select("value", (-F.element_at(F.array("best.*"), 2)).cast("int").alias("kind"))
        if added:
            new = new.join(reduce(DataFrame.unionByName, added), "value", "left_anti")
        new = materialize(new, "learned")
        if new.limit(1).count() == 0:
            break
        added.append(new)
        if len(added) == TABLES:
            added = [materialize(reduce(DataFrame.unionByName, added), "learned")]
    if not added:
        return known.limit(0)
    return reduce(DataFrame.unionByName, added)


def find_pii(docs: DataFrame, least_seeds: int = 4, confidence: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the fixed patterns. ``spans`` also holds what was learned:
    tokens with a digit or an at sign whose two preceding words are a trusted context, or whose
    value stood in one elsewhere, over as many steps as there are. Spans are kind:start:end in code points, by kind in the
    order of KINDS, then start. Null counts as the empty text; repeated rows get equal rows; an
    empty table gives none. Only doc_id and text are read.
    """
    keyed = Keyed(docs)
    found = materialize(_found(keyed), "found")
    graph = found.select("_key", F.explode("mentions").alias("m")).select("_key", "m.*")
    in_context = graph.filter("context is not null").groupBy("kind", "context", "value").agg(F.count(F.lit(1)).alias("n"))
    in_context = materialize(in_context, "graph")  # a value or context in very many texts is a few rows
    # others cannot be trusted in any round
    contexts = in_context.groupBy("context").agg(F.count_distinct("value").alias("n"))
    contexts = materialize(contexts.filter(F.col("n") >= least_seeds).select("context"), "contexts")
    totals = materialize(context_totals(keyed.frame, contexts), "totals")
    values = learned(in_context, totals, least_seeds, confidence)
    values = values.withColumnRenamed("kind", "found_kind")
    more = graph.filter("kind < 0").join(values, "value").groupBy("_key").agg(
        F.collect_list(F.struct(F.col("found_kind").cast("int").alias("kind"), "s", "e")).alias("more")
    )
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.s, x.e)), ","
    )
    count = lambda i: F.size(F.filter("base", lambda x: x.kind == i)).cast("long").alias(f"n_{KINDS[i]}")
    empty = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    every = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("more"), empty)))
    return found.join(more, "_key", "left").select(
        "doc_id", *(count(i) for i in range(4)), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"),
    )
