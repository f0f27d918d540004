"""Quality score of whole texts by a small byte-level convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import raw_texts
from cohortspark.llm.labelled import labelled_sample, remainder

WIDTH = 6  # bytes under a filter
FILTERS = 12
HALF = 256  # a chunk is two halves; adjacent chunks share one
LAGS = range(2, 34)  # a byte repeats when its next four bytes also stand this far before it
BLOCK = 1 << 15


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes from a position also stood a short way before it."""
    g = np.zeros(len(data), np.uint32)
    if len(data) >= 4:
        for j in range(4):
            g[: len(data) - 3] |= data[j : len(data) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
        g[len(data) - 3 :] = np.arange(1, 4)
    out = np.zeros(len(data), bool)
    for lag in LAGS:
        if lag < len(data):
            out[lag:] |= g[lag:] == g[:-lag]
    return out & (g > 255)  # padding does not repeat


@dataclass
class ByteNet:
    """Filters as tables: response at i is the sum over j of taps[j, byte i+j], plus echo times
    the repeated bytes under the filter. Pooled by maximum over each chunk; a document is the
    mean and the maximum over its chunks, weighed into one logit."""

    taps: np.ndarray
    echo: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    shift: float

    def layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts one after another, each padded with zeros to whole halves; halves per text."""
        halves = np.array([max(2, -(-(len(t) + WIDTH) // HALF)) for t in texts])
        data = b"".join(t.ljust(h * HALF, b"\0") for t, h in zip(texts, halves.tolist(), strict=True))
        return np.frombuffer(data, np.uint8), halves

    def responses(self, data: np.ndarray, again: np.ndarray) -> np.ndarray:
        """For bytes (with WIDTH zeros behind them): the filters' responses at each position."""
        n = len(data) - WIDTH
        pairs = data[:-1].astype(np.int32) << 8 | data[1:]
        out = np.take(self._pairs[0], pairs[:n], axis=0)
        for j in range(2, WIDTH, 2):
            out += np.take(self._pairs[j // 2], pairs[j : j + n], axis=0)
        total = np.concatenate([[0], np.cumsum(again, dtype=np.int32)])
        out += (total[WIDTH : WIDTH + n] - total[:n]).astype(np.float32)[:, None] * self.echo
        return out

    def prepare(self) -> None:
        self._pairs = [
            (self.taps[j][:, None, :] + self.taps[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32)
            for j in range(0, WIDTH, 2)
        ]

    def pool(self, data: np.ndarray) -> np.ndarray:
        """Maximum response of each half."""
        again = np.concatenate([repeats(data), np.zeros(WIDTH, bool)])
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        out = np.empty((len(data) // HALF, FILTERS), np.float32)
        for start in range(0, len(data), BLOCK):
            end = min(start + BLOCK, len(data))
            block = self.responses(padded[start : end + WIDTH], again[start : end + WIDTH])
            out[start // HALF : end // HALF] = block.reshape(-1, HALF, FILTERS).max(axis=1)
        return out

    def features(self, pooled: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each text, from the maxima of its halves."""
        ends = np.cumsum(halves)
        chunk = np.maximum(pooled[:-1], pooled[1:])  # a chunk is a half and the next one
        inside = np.ones(len(pooled) - 1, bool)
        inside[ends[:-1] - 1] = False
        hidden = np.maximum(chunk[inside] + self.bias, 0)
        counts = halves - 1
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(hidden, starts, axis=0) / counts[:, None]
        return np.concatenate([mean, np.maximum.reduceat(hidden, starts, axis=0)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        data, halves = self.layout(texts)
        logit = self.features(self.pool(data), halves).astype(np.float64) @ self.head + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(
    texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7, steps: int = 700,
) -> ByteNet:
    """Fits the filters and the head by Adam on the log loss; the gradient goes through the maxima.

    Takes at least ``steps`` steps: a small sample is gone through more often.
    """
    epochs = max(epochs, -(-steps * batch // max(1, len(texts))))
    rng = np.random.default_rng(seed)
    net = ByteNet(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), rng.normal(0.1, 0.1, FILTERS),
                  np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        net.head[:] = 0
        net.shift = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        net.prepare()
        return net
    params = {"taps": net.taps, "echo": net.echo, "bias": net.bias, "head": net.head, "shift": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            net.shift = float(params["shift"][0])
            net.prepare()
            grads = _gradients(net, [texts[i] for i in rows], labels[rows])
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                slow = rate * (1 - epoch / epochs)
                params[k] -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    net.shift = float(params["shift"][0])
    net.prepare()
    return net


def _gradients(net: ByteNet, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    data, halves = net.layout(texts)
    again = np.concatenate([repeats(data), np.zeros(WIDTH, bool)])
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    full = net.responses(padded, again).reshape(-1, HALF, FILTERS)
    best = full.argmax(axis=1)  # position of the maximum within each half
    pooled = np.take_along_axis(full, best[:, None, :], axis=1)[:, 0, :]
    ends = np.cumsum(halves)
    inside = np.ones(len(pooled) - 1, bool)
    inside[ends[:-1] - 1] = False
    left = np.flatnonzero(inside)
    second_half = pooled[left + 1] > pooled[left]
    raw = np.maximum(pooled[left], pooled[left + 1]) + net.bias
    hidden = np.maximum(raw, 0)
    counts = halves - 1
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(texts)), counts)
    mean = np.add.reduceat(hidden, starts, axis=0) / counts[:, None]
    top = np.maximum.reduceat(hidden, starts, axis=0)
    x = np.concatenate([mean, top], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ net.head + net.shift, -30, 30)))
    d = (p - labels) / len(labels)
    d_hidden = d[doc, None] * net.head[None, :FILTERS] / counts[doc, None]
    is_top = hidden == top[doc]
    d_hidden = d_hidden + np.where(is_top, d[doc, None] * net.head[None, FILTERS:], 0)
    d_hidden = np.where(raw > 0, d_hidden, 0)
    half = left[:, None] + second_half
    position = half * HALF + np.take_along_axis(best, half, axis=0)
    taps, f = np.zeros_like(net.taps), np.broadcast_to(np.arange(FILTERS), position.shape)
    for j in range(WIDTH):
        np.add.at(taps[j], (padded[position + j], f), d_hidden)
    total = np.concatenate([[0], np.cumsum(again)])
    under = total[np.minimum(position + WIDTH, len(total) - 1)] - total[position]
    return {"taps": taps + 1e-5 * net.taps, "echo": (d_hidden * under).sum(0), "bias": d_hidden.sum(0),
            "head": x.T @ d + 1e-4 * net.head, "shift": np.array([d.sum()])}


def score_quality(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, cutoff: float = 0.3,
    rows: tuple[int, int] = (1200, 1800), pieces: int = 6, size: int = 512,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The network learns from at most ``rows`` labelled documents of class 0 and 1 whose crc32
    remainder is not ``held_out``, and of each at most ``pieces`` slices of ``size`` bytes; it
    scores every whole text. Null counts as the empty text, which gets a score too; repeated
    rows get equal scores; a null doc_id is not held out. Without labels of both classes
    every text gets the share of class 1. Only doc_id and text are read.
    """
    net = train(*labelled_sample(docs, labels, "quality", modulus, held_out, dict(enumerate(rows)), pieces, size))
    return with_scores(docs, net.score, modulus, held_out, cutoff)


def with_scores(docs: DataFrame, score, modulus: int, held_out: int, cutoff: float) -> DataFrame:
    """doc_id, held_out, score and predicted from a function of a list of texts."""
    is_out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", is_out, "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = raw_texts(batch), []
            for part in by_size(texts):
                scores.append(score(part))
            result = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(result), pa.array((result >= cutoff).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return picked.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def by_size(texts: list[bytes], most: int = 1 << 21) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about ``most`` bytes or one text."""
    part: list[bytes] = []
    held = 0
    for text in texts:
        part.append(text)
        held += len(text) + 64
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part
