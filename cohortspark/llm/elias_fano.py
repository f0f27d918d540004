"""Elias-Fano coding of monotone sequences, and an n-gram trie level made of them."""

from __future__ import annotations

import mmap
import struct

import numpy as np

HEADER = "<QQB"


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of integers below 2^63: about 2 + log2(largest / n) bits each."""
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    if n == 0:
        return struct.pack(HEADER, 0, 0, 0)
    low_bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    unary = np.packbits(unary)
    low = np.empty((n, low_bits), np.uint8)
    for j in range(low_bits):
        low[:, j] = (values >> np.uint64(j)) & np.uint64(1)
    return struct.pack(HEADER, n, len(unary), low_bits) + unary.tobytes() + np.packbits(low).tobytes()


def decode(data, at: int = 0) -> tuple[np.ndarray, int]:
    """The sequence that begins at byte ``at``, and where the next one begins."""
    n, size, low_bits = struct.unpack_from(HEADER, data, at)
    at += struct.calcsize(HEADER)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, at))
    values = (np.flatnonzero(unary)[:n] - np.arange(n)).astype(np.int64) << low_bits
    at += size
    packed = -(-n * low_bits // 8)
    if packed:
        low = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=n * low_bits).reshape(n, low_bits)
        for j in range(low_bits):
            values |= low[:, j].astype(np.int64) << j
    return values, at + packed


class TrieLevel:
    """Successors of contexts: contexts, pointers to where their successors begin, and the
    successors, made monotone by adding the rank of their context times the vocabulary.

    ``context`` and ``word`` are distinct pairs sorted by both; ``vocabulary`` is above every word.
    """

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, vocabulary: int) -> bytes:
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        starts = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        pointers = np.concatenate([starts, [len(context)]])
        return encode(context[new]) + encode(pointers) + encode(rank * vocabulary + word)

    @staticmethod
    def read(data, vocabulary: int, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """All pairs (context, word) in order, and where the data behind them begins."""
        contexts, at = decode(data, at)
        pointers, at = decode(data, at)
        raised, at = decode(data, at)
        rank = np.repeat(np.arange(len(contexts)), np.diff(pointers))
        return contexts[rank], raised - rank * vocabulary, at


class MappedLevel:
    """A trie level with one byte per successor in an anonymous memory map: nothing is left on the
    machine, and the map goes as a whole when it is closed. The kept form of a level is its row."""

    def __init__(self, level: bytes, codes: bytes, vocabulary: int):
        self.map = mmap.mmap(-1, len(level) + len(codes))
        self.map.write(level)
        self.map.write(codes)
        self.vocabulary = vocabulary
        self.contexts, at = decode(self.map)
        self.pointers, at = decode(self.map, at)
        self.raised, at = decode(self.map, at)
        self.codes = np.frombuffer(self.map, np.uint8, len(codes), at)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs; 0 where a pair is not held. The context's rank turns the word into a
        place in the monotone sequence, whose next element is the successor looked for."""
        if not len(self.contexts):
            return np.zeros(len(context), np.uint8)
        rank = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        wanted = rank * self.vocabulary + word
        place = np.minimum(np.searchsorted(self.raised, wanted), len(self.raised) - 1)
        hit = (self.contexts[rank] == context) & (self.raised[place] == wanted)
        return np.where(hit, self.codes[place], 0).astype(np.uint8)

    def close(self) -> None:
        del self.codes
        self.map.close()
