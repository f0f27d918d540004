"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import raw_texts, small_batches
from cohortspark.llm.labelled import labelled_sample, remainder
from cohortspark.llm.quality import by_size

CHAIN = 64  # tokens of a text that are worked on in one row; messages go on to the next row
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7)  # bytes
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def word_features(word: bytes) -> list[int]:
    """Buckets of the bare word and of its first bytes."""
    bare = word.strip(EDGES)
    parts = [b"w" + bare] + [b"p%d" % n + bare[:n] for n in PREFIXES if len(bare) > n]
    return [xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts]


def factorised(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All lower-cased tokens of the texts as numbers of distinct words; those; tokens per text."""
    words, counts = [], []
    for text in texts:
        own = text.lower().split()
        counts.append(len(own))
        words += own
    if not words:
        return np.empty(0, np.int64), [], np.array(counts, np.int64)
    column = np.empty(len(words), dtype=object)
    column[:] = words
    codes, distinct = pd.factorize(column)
    return codes, list(distinct), np.array(counts, np.int64)


def feature_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words in one array, and the word each belongs to."""
    found = [word_features(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(f) for f in found])
    return np.fromiter((b for f in found for b in f), np.int64, len(owner)), owner


def chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of every token, CHAIN tokens a row, and whether a row is the first of its text."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    within = np.arange(counts.sum()) - np.repeat(starts, counts)
    per_text = -(-counts // CHAIN)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    begins = np.zeros(per_text.sum(), bool)
    begins[first[per_text > 0]] = True
    return np.repeat(first, counts) + within // CHAIN, within % CHAIN, begins


def marginals(
    emission: np.ndarray, length: np.ndarray, trans: np.ndarray, begins: np.ndarray | None = None, rows: int = 2000
) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over rows of emissions (log odds of state 1), ``rows`` rows at once.

    Returns the probability of state 1 at each token and the expected number of each
    transition; ``length`` is the tokens of each row. A row that does not begin a text goes on
    with the chain of the row before it, so the marginals are those of whole texts. Without
    ``begins`` every row is a text.
    """
    begins = np.ones(len(emission), bool) if begins is None else begins
    entry, behind = _messages(emission, length, trans, begins, rows)
    p, pairs = np.empty(emission.shape), np.zeros((2, 2))
    for i in range(0, len(emission), rows):
        part = slice(i, i + rows)
        p[part], more = _forward_backward(emission[part], length[part], trans, begins[part], entry[part], behind[part])
        pairs += more
    return p, pairs


def _messages(emission: np.ndarray, length: np.ndarray, trans: np.ndarray, begins: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the forward message of the token before its first and the backward message of
    its last token. A row acts on messages as a product of 2 x 2 matrices, found for all rows
    side by side; then the messages go from row to row of each text."""
    entry, behind = np.ones((len(emission), 2)), np.ones((len(emission), 2))
    inner = ~begins  # rows with one before them in their text
    ends = np.append(begins[1:], True)
    several = np.flatnonzero(inner | ~ends)
    through = np.empty((len(several), 4))
    for i in range(0, len(several), rows):
        part = several[i : i + rows]
        through[i : i + rows] = _transfers(emission[part], length[part], trans)
    a00, a01, a10, a11 = np.exp(trans).ravel().tolist()
    steps = list(zip(several.tolist(), inner[several].tolist(), ends[several].tolist(), through.tolist(), strict=True))
    f0 = f1 = 1.0
    for row, goes_on, _, (t00, t01, t10, t11) in steps:
        x0 = x1 = 1.0
        if goes_on:
            entry[row] = f0, f1
            x0, x1 = f0 * a00 + f1 * a10, f0 * a01 + f1 * a11
        f0, f1 = x0 * t00 + x1 * t10, x0 * t01 + x1 * t11
        f0, f1 = f0 / (f0 + f1), f1 / (f0 + f1)
    b0 = b1 = 1.0
    for row, _, is_last, (t00, t01, t10, t11) in reversed(steps):
        if is_last:
            b0 = b1 = 1.0
        behind[row] = b0, b1
        x0, x1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
        b0, b1 = a00 * x0 + a01 * x1, a10 * x0 + a11 * x1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    return entry, behind


def _transfers(emission: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The matrix of each row, from its first token's state to its last one's, emissions included
    and scaled: 00, 01, 10, 11."""
    a, odds = np.exp(trans), np.exp(np.clip(emission, -30, 30))
    m = np.stack([np.ones(len(odds)), np.zeros(len(odds)), np.zeros(len(odds)), odds[:, 0]])
    for i in range(1, odds.shape[1]):
        to = [m[x] * a[0, y] + m[x + 1] * a[1, y] for x in (0, 2) for y in (0, 1)]
        moved = np.stack([to[0], to[1] * odds[:, i], to[2], to[3] * odds[:, i]])
        m = np.where(i < length, moved / moved.sum(axis=0), m)
    return m.T


def _forward_backward(
    emission: np.ndarray, length: np.ndarray, trans: np.ndarray, begins: np.ndarray, entry: np.ndarray, behind: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The marginals and transitions of some rows; messages are scaled at each step."""
    n, t = emission.shape
    a = np.exp(trans)
    odds = np.exp(np.clip(emission, -30, 30))
    live = np.arange(t)[None, :] < length[:, None]
    forward, backward = np.empty((t, 2, n)), np.empty((t, 2, n))
    f0, f1 = entry.T
    for i in range(t):
        to0, to1 = f0 * a[0, 0] + f1 * a[1, 0], f0 * a[0, 1] + f1 * a[1, 1]
        if i == 0:
            to0, to1 = np.where(begins, 1, to0), np.where(begins, 1, to1)
        f0, f1 = to0, to1 * odds[:, i]
        total = f0 + f1
        f0, f1 = f0 / total, f1 / total
        forward[i] = f0, f1
    b0, b1 = behind.T
    for i in range(t - 1, -1, -1):
        backward[i] = b0, b1
        x0, x1 = b0, b1 * odds[:, i]
        n0, n1 = a[0, 0] * x0 + a[0, 1] * x1, a[1, 0] * x0 + a[1, 1] * x1
        total = n0 + n1
        # what is behind a row's last token comes from the next row
        b0, b1 = np.where(live[:, i], n0 / total, b0), np.where(live[:, i], n1 / total, b1)
    both = forward * backward
    p = (both[:, 1] / both.sum(axis=1)).T * live
    pairs = np.zeros((2, 2))
    for i in range(t):
        before, counted = (forward[i - 1], live[:, i]) if i else (entry.T, ~begins)
        weight = [[before[x] * a[x, y] * (odds[:, i] if y else 1) * backward[i, y] for y in (0, 1)] for x in (0, 1)]
        total = sum(w for row in weight for w in row)
        for x in (0, 1):
            for y in (0, 1):
                pairs[x, y] += (weight[x][y] / total)[counted].sum()
    return p, pairs


@dataclass
class SpanTagger:
    """Weights of hashed features, transitions, and a logistic curve from marginals to a score."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    curve: np.ndarray
    trained: bool = True

    def tagged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of every token, and tokens per text."""
        codes, words, counts = factorised(texts)
        if not words:
            return np.empty(0), counts
        bucket, owner = feature_table(words)
        emission = np.bincount(owner, self.weights[bucket], len(words)) + self.bias
        row, column, begins = chains(counts)
        table = np.zeros((len(begins), CHAIN))
        table[row, column] = emission[codes]
        p, _ = marginals(table, np.bincount(row), self.trans, begins)
        return p[row, column], counts

    def evidence(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text: 1, log of 1 + expected toxic tokens, largest marginal, share of toxic tokens
        (up to one in fifty), log of 1 + tokens."""
        doc = np.repeat(np.arange(len(counts)), counts)
        expected = np.bincount(doc, p, len(counts))
        largest = np.zeros(len(counts))
        np.maximum.at(largest, doc, p)
        return np.stack([np.ones(len(counts)), np.log1p(expected), largest,
                         np.minimum(1, 50 * expected / np.maximum(counts, 1)), np.log1p(counts)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.evidence(*self.tagged(texts)) @ self.curve)

    def spans(self, texts: list[bytes], p: np.ndarray, counts: np.ndarray, cutoff: float = 0.5) -> list[str]:
        """Offending tokens of each text as start:end in code points, adjacent ones joined."""
        ends = np.cumsum(counts)
        out = []
        for text, end, n in zip(texts, ends.tolist(), counts.tolist(), strict=True):
            hit = p[end - n : end] >= cutoff
            if not hit.any():
                out.append("")
                continue
            lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            found: list[list[int]] = []
            for i, m in enumerate(TOKEN.finditer(text)):
                if hit[i]:
                    start, stop = int(lead[m.start()]) - 1, int(lead[m.end() - 1])
                    if found and i and hit[i - 1]:
                        found[-1][1] = stop
                    else:
                        found.append([start, stop])
            out.append(",".join(f"{a}:{b}" for a, b in found))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def token_labels(codes: np.ndarray, words: list[bytes], counts: np.ndarray, labels: np.ndarray, ratio: float = 12.0, least: int = 5) -> np.ndarray:
    """Token labels from document labels: a token of a toxic document is toxic if its word, or
    the start of its word, is much more frequent in toxic documents than in others.

    Frequency counts distinct pairs of a word and the word before it, so that copies of a
    document count once: at least ``least`` pairs, and ``ratio`` times the share they have among
    the pairs of the other documents.
    """
    bucket, owner = feature_table(words)
    before = np.concatenate([[len(words)], codes[:-1]])
    starts = np.cumsum(counts)[:-1]
    before[starts[starts < len(codes)]] = len(words)
    is_toxic = np.repeat(labels, counts) == 1
    shares = []
    for group in (is_toxic, ~is_toxic):
        pairs = np.unique(codes[group] * (len(words) + 1) + before[group])
        per_word = np.bincount(pairs // (len(words) + 1), minlength=len(words))
        shares.append((np.bincount(bucket, per_word[owner], BUCKETS), max(1, len(pairs))))
    (toxic, n_toxic), (clean, n_clean) = shares
    seed = (toxic >= least) & ((toxic / n_toxic) / ((clean + 0.5) / n_clean) >= ratio)
    marked = np.bincount(owner, seed[bucket], len(words)) > 0
    return (marked[codes] & is_toxic).astype(np.float64)


def train(texts: list[bytes], labels: np.ndarray, steps: int = 40, rate: float = 0.3, decay: float = 1e-4) -> SpanTagger:
    """Fits the field to the token labels by Adagrad on its likelihood, then the document curve."""
    codes, words, counts = factorised(texts)
    base = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    tagger = SpanTagger(np.zeros(BUCKETS), -4.0, np.zeros((2, 2)), np.array([base, 0, 0, 0, 0]), trained=False)
    if not words or len(set(labels.tolist())) < 2:
        return tagger
    tagger.trained = True
    y = token_labels(codes, words, counts, labels)
    bucket, owner = feature_table(words)
    row, column, begins = chains(counts)
    length = np.bincount(row)
    table = np.zeros((len(length), CHAIN))
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:-1] == text[1:]
    seen = np.array([[(inside & (y[:-1] == x) & (y[1:] == z)).sum() for z in (0, 1)] for x in (0, 1)])
    scale = max(1.0, y.sum())
    squares = [np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(steps):
        table[row, column] = (np.bincount(owner, tagger.weights[bucket], len(words)) + tagger.bias)[codes]
        p, pairs = marginals(table, length, tagger.trans, begins)
        miss = y - p[row, column]
        by_word = np.bincount(codes, miss, len(words))
        grads = [np.bincount(bucket, by_word[owner], BUCKETS) / scale - decay * tagger.weights,
                 miss.sum() / scale, (seen - pairs) / scale - decay * tagger.trans]
        squares = [s + g * g for s, g in zip(squares, grads, strict=True)]
        moves = [rate * g / np.sqrt(s) for g, s in zip(grads, squares, strict=True)]
        tagger.weights = tagger.weights + moves[0]
        tagger.bias += float(moves[1])
        tagger.trans = tagger.trans + moves[2]
    x = tagger.evidence(*tagger.tagged(texts))
    curve = np.zeros(5)
    for _ in range(30):  # Newton steps on the penalised log loss
        q = _sigmoid(x @ curve)
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(5)
        curve -= np.linalg.solve(hessian, x.T @ (q - labels) + 0.01 * curve)
    tagger.curve = curve
    return tagger


def train_tagger(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2,
    rows: tuple[int, int] = (1600, 1000), pieces: int = 6, size: int = 1024,
) -> SpanTagger:
    """Trains on at most ``rows`` labelled documents of class 0 and 1 whose crc32 remainder is
    not ``held_out``, and of each at most ``pieces`` slices of ``size`` bytes."""
    return train(*labelled_sample(docs, labels, "toxic", modulus, held_out, dict(enumerate(rows)), pieces, size))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, cutoff: float = 0.3, **sample,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_toxic_tokens, toxic_spans.

    A whole text is one chain. toxic_spans lists the offending places as
    start:end in code points (end exclusive), n_toxic_tokens counts tokens with a marginal of
    at least one half. Null counts as the empty text, which has a score and no spans; repeated
    rows get equal rows; a null doc_id is not held out. Without labels of both classes every
    text gets the share of class 1. Of ``docs`` only doc_id and text are read.
    """
    return _scored(docs, train_tagger(docs, labels, modulus, held_out, **sample), modulus, held_out, cutoff)


def _scored(docs: DataFrame, tagger: SpanTagger, modulus: int, held_out: int, cutoff: float) -> DataFrame:
    is_out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", is_out, "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, tokens, spans = [np.empty(0)], [np.empty(0, np.int64)], []
            for part in by_size(raw_texts(batch)):
                p, counts = tagger.tagged(part)
                scores.append(_sigmoid(tagger.evidence(p, counts) @ tagger.curve))
                doc = np.repeat(np.arange(len(part)), counts)
                tokens.append(np.bincount(doc[p >= 0.5], minlength=len(part)))
                spans += tagger.spans(part, p, counts)
            result = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(result), pa.array((result >= cutoff).astype(np.int32)),
                 pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(spans, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "n_toxic_tokens", "toxic_spans"],
            )

    return picked.mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int, n_toxic_tokens long, toxic_spans string"
    )


def without_toxic(docs: DataFrame, tagger: SpanTagger, cutoff: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``cutoff``, with all their columns. A tagger that had
    no labels of both classes to learn from rejects nothing."""
    if not tagger.trained:
        return docs
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [s < cutoff for part in by_size(raw_texts(batch)) for s in tagger.score(part)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
