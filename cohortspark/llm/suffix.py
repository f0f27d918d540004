"""Suffix arrays by induced sorting, a bucket of suffixes at a time."""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the suffix that follows. The last one (the unique
    smallest symbol) is S-type."""
    n = len(text)
    step = np.diff(text.astype(np.int32))  # above 0: rises
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(at[::-1])[::-1]  # next place where the symbol changes
    out = np.ones(n, bool)
    inner = following < n
    out[:-1][inner] = step[following[inner]] > 0
    return out


def _deal(positions: np.ndarray, symbols: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Appends positions to the lists of their symbols, in order."""
    if not len(positions):
        return
    order = np.argsort(symbols, kind="stable")
    ordered, symbols = positions[order], symbols[order]
    begins = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    for begin, end in zip(begins.tolist(), np.append(begins[1:], len(ordered)).tolist(), strict=True):
        lists[symbols[begin]].append(ordered[begin:end])


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: list[list[np.ndarray]], alphabet: int) -> tuple[list, list]:
    """L-type suffixes from the seeds (S-type, ascending by bucket), then all S-type suffixes from
    the L-type ones. Returns both by bucket; the S-type lists run downwards.

    A bucket first yields what it already holds; suffixes it adds to itself make the next wave.
    """
    rising: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    for c in range(alphabet):
        wave = np.concatenate(rising[c]) if rising[c] else np.empty(0, np.int32)
        while len(wave):
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            symbols = text[before]
            same = symbols == c
            wave = before[same]
            if len(wave):
                rising[c].append(wave)
            _deal(before[~same], symbols[~same], rising)
        for part in seeds[c]:
            before = part[part > 0] - 1
            before = before[~is_s[before]]
            _deal(before, text[before], rising)
    falling: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    for c in range(alphabet - 1, -1, -1):
        wave = np.concatenate(falling[c]) if falling[c] else np.empty(0, np.int32)
        while len(wave):
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            symbols = text[before]
            same = symbols == c
            wave = before[same]
            if len(wave):
                falling[c].append(wave)
            _deal(before[~same], symbols[~same], falling)
        if rising[c]:
            part = np.concatenate(rising[c])[::-1]
            before = part[part > 0] - 1
            before = before[is_s[before]]
            _deal(before, text[before], falling)
    return rising, falling


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order: equal substrings get equal names."""
    ends = np.append(lms[1:], len(text) - 1)
    length = np.zeros(len(text), np.int64)
    length[lms] = ends - lms
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        equal = text[a[active] + offset] == text[b[active] + offset]
        same[active[~equal]] = False
        active = active[equal]
        active = active[length[a[active]] > offset]  # the first symbol of the next one counts too
        offset += 1
    name = np.empty(len(text), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _reduced(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names: pairs of names are named again, at twice the
    distance each time, until all names differ."""
    rank, distance, n = names, 1, len(names)
    while True:
        largest = int(rank.max()) + 1
        behind = np.zeros(n, np.int64)
        behind[: n - distance] = rank[distance:] + 1
        pair = rank * (largest + 1) + behind
        order = np.argsort(pair)
        new = np.ones(n, bool)
        new[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        distance *= 2


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes of ``text`` in order. Its last symbol must be 0 and occur nowhere else."""
    is_s = types(text)
    is_lms = is_s.copy()
    is_lms[1:] &= ~is_s[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms).astype(np.int32)  # half the memory traffic; a shard is small
    if not len(lms):
        return np.argsort(text, kind="stable")  # one symbol only
    seeds: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    _deal(lms, text[lms], seeds)
    _, falling = _induce(text, is_s, seeds, alphabet)
    down = [np.concatenate(x) if x else np.empty(0, np.int32) for x in falling]
    ordered = np.concatenate([x[is_lms[x]][::-1] for x in down])
    ordered = np.concatenate([lms[-1:], ordered[ordered != lms[-1]]])
    order = _reduced(_names(text, lms, ordered))
    sorted_lms = lms[order]
    seeds = [[] for _ in range(alphabet)]
    _deal(sorted_lms, text[sorted_lms], seeds)
    rising, falling = _induce(text, is_s, seeds, alphabet)
    out = [np.array([len(text) - 1], np.int32)]
    for c in range(1, alphabet):
        out += rising[c]
        if falling[c]:
            out.append(np.concatenate(falling[c])[::-1])
    return np.concatenate(out)


def permuted_lcp(text: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in order (-1 for the first) and how many symbols
    both share.

    Where the two have the same symbol in front of them, the value is one less than that of
    the position before; only the others are compared, several symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = text[at[follows] - 1] == text[before[follows] - 1]
    start = np.flatnonzero(~follows)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    four = padded[: n + 4].copy()
    for j in range(1, 4):
        four |= padded[j : n + 4 + j] << np.uint64(16 * j)
    shared = np.zeros(len(start), np.int64)
    active = np.flatnonzero(before[start] >= 0)
    while len(active):
        i, k = start[active] + shared[active], before[start[active]] + shared[active]
        active = active[four[i] == four[k]]
        shared[active] += 4
    for _ in range(3):
        i, k = start + shared, before[start] + shared
        good = before[start] >= 0
        good[good] = text[i[good]] == text[k[good]]
        shared[good] += 1
    whole = np.zeros(n, np.int64)
    whole[start] = shared
    origin = np.maximum.accumulate(np.where(follows, 0, at))
    return before, whole[origin] - (at - origin)
