"""SentencePiece encoding with a score-ordered agenda of adjacent symbol pairs, and decoding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from cohortspark.llm.common import Memory, raw_texts, small_batches
from cohortspark.llm.quality import by_size

SPACE_MARK = "▁"
SEGMENTS = 1 << 19  # twice as many distinct segments have their ids remembered by a worker
SHORT = 64  # symbols of a segment whose agenda is kept in arrays; results are the same either way
NEVER = np.iinfo(np.int32).max
WIDTHS = (8, 16, 32)  # segments up to so many symbols are rows of one matrix, longer ones of another
BLOCK = 1 << 20  # characters that are cut at once
KINDS = 4096  # characters of longer pieces that are told apart where texts are cut; the rarer ones count as one
SPREAD = -7046029254386353131  # an odd multiplier that spreads codes over the upper bits


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin`` ... ``begin + size - 1`` of each run, one run after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


class PairTable:
    """What each of many 64-bit codes (0 or more) stands for, looked up for whole arrays of codes."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(codes)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.codes = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at = self._place(codes)
        while len(codes):
            free = self.codes[at] < 0
            self.codes[at[free]] = codes[free]
            placed = self.codes[at] == codes
            self.values[at[placed]] = values[placed]
            codes, values, at = codes[~placed], values[~placed], (at[~placed] + 1) & self.last

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * SPREAD).view(np.uint64) >> self.shift).view(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The value of each code, or -1."""
        at = self._place(codes)
        there = self.codes[at]
        out = np.where(there == codes, self.values[at], -1)
        lost = np.flatnonzero((there != codes) & (there >= 0))
        at = at[lost]
        while len(lost):  # the place is another code's: the next ones, up to a free one
            at = (at + 1) & self.last
            there = self.codes[at]
            same = there == codes[lost]
            out[lost[same]] = self.values[at[same]]
            on = ~same & (there >= 0)
            lost, at = lost[on], at[on]
        return out


class MergeVocabulary:
    """A merge-type vocabulary with byte fallback, from the bytes of a model file.

    Normalisation (white space as marks, the mark in front) is the library's. Everything after it is
    done here: the agenda holds the adjacent pairs of symbols that form a piece, best score first and then
    leftmost, and merges until no pair is left. No merge crosses two characters that are adjacent in no
    piece, so texts are cut between any such two; a segment that returns need not be encoded again. The
    agendas of many short segments are kept side by side in arrays, a long segment has a heap.
    """

    def __init__(self, model: bytes):
        self.library = library = SentencePieceProcessor(model_proto=model)
        self.size = library.vocab_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [-1] * 256
        self.surface: list[bytes] = []
        self.plain = np.ones(self.size, bool)  # a piece that is neither control nor unknown
        for i in range(self.size):
            piece = library.id_to_piece(i)
            if library.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if library.is_control(i):
                self.surface.append(b"")
                self.plain[i] = False
            elif library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
                self.plain[i] = False
            elif library.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append(piece.replace(SPACE_MARK, " ").encode())
                self.id[piece] = i
                self.score[piece] = -library.get_score(i)
        if -1 in self.byte_id:
            raise ValueError("a vocabulary with byte fallback is needed")
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_size = np.array([len(x) for x in self.surface])
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        self.spaced = np.array([x[:1] == b" " for x in self.surface])
        self.spaced[self.byte_id[32]] = False
        self.end = library.eos_id()
        self.prefixed = library.normalize("a") != "a"
        longer = [piece for piece in self.id if len(piece) > 1]
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no longer piece
        for i, (c, _) in enumerate(Counter(c for piece in longer for c in piece).most_common()):
            self.kind[ord(c)] = min(i, KINDS - 2) + 1
        self.kinds = int(self.kind.max()) + 1
        self.cuts = np.ones(self.kinds * self.kinds, bool)  # whether a segment begins between two kinds
        for piece in longer:
            for a, b in pairwise(piece):
                self.cuts[self.kind[ord(a)] * self.kinds + self.kind[ord(b)]] = False
        self.known: Memory[bytes] = Memory(SEGMENTS, SHORT)
        self._pair_table(longer)

    def _pair_table(self, longer: list[str]) -> None:
        """The pairs of symbols that form a piece, each piece's rank, and each character's number."""
        pairs = {}
        for piece in longer:
            for k in range(1, len(piece)):
                left, right = self._code(piece[:k]), self._code(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = self.id[piece]
        self.pairs = PairTable(np.array([*pairs], np.int64), np.array([*pairs.values()], np.int32))
        scores = np.full(self.size, np.inf)
        scores[list(self.id.values())] = list(self.score.values())
        self.rank = np.append(np.unique(scores, return_inverse=True)[1], NEVER).astype(np.int32)  # the last for -1
        self.code_of = self.size + np.arange(0x110000, dtype=np.int32)
        self.nothing = self.size + 0x110000  # beside a segment; forms no piece
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.code_of[ord(piece)] = i

    def _code(self, symbol: str) -> int | None:
        """A symbol's number: its id, or for a character without one a number beyond all ids."""
        return self.id.get(symbol, self.size + ord(symbol) if len(symbol) == 1 else None)

    def _formed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols forms, or -1."""
        return self.pairs.find(left.astype(np.int64) << 32 | right)

    def _merged_side_by_side(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all segments, in order, and how many of them each segment has."""
        size = np.array([len(s) for s in segments])
        width = np.searchsorted(WIDTHS, size)
        done = []
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            left, row = self._merged_rows([segments[i] for i in rows.tolist()], size[rows])
            done.append((rows[row], left))
        owner, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return code[order], np.bincount(owner, minlength=len(segments))

    def _merged_rows(self, segments: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all segments, in order, and the segment of each. A segment is a row of a
        matrix with an empty place at least behind it; a round takes the first entry of every row's agenda."""
        width = int(size.max()) + 1
        inside = np.arange(width) < size[:, None]
        at = np.flatnonzero(inside)
        code = np.full(inside.size, self.nothing, np.int32)
        code[at] = self.code_of[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        pair = np.full(inside.size, -1, np.int32)
        pair[at] = self._formed(code[at], code[at + 1])
        rank = self.rank[pair]
        before, after = np.arange(-1, inside.size - 1), np.arange(1, inside.size + 1)
        by_row = rank.reshape(inside.shape)
        rows = np.arange(len(segments))
        while True:
            i = rows * width + by_row[rows].argmin(1)
            more = rank[i] < NEVER
            rows, i = rows[more], i[more]
            if not len(rows):
                break
            j, h = after[i], before[i]
            k = after[j]
            code[i], code[j], rank[j] = pair[i], -1, NEVER
            after[i], before[k] = k, i
            left = np.concatenate([h, i])
            pair[left] = formed = self._formed(code[left], code[np.concatenate([i, k])])
            rank[left] = self.rank[formed]
        at = at[code[at] >= 0]
        return code[at], at // width

    def merged(self, segment: str) -> list[str]:
        """The symbols of ``segment`` when no adjacent pair forms a piece any more."""
        symbols: list[str | None] = list(segment)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = segment[i : i + 2]
            if pair in score:
                agenda.append((score[pair], i, pair))
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            j = after[i]
            if symbols[i] is None or j == n or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # a better pair took one of the two
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in score:
                    heappush(agenda, (score[longer], i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in score:
                    heappush(agenda, (score[longer], h, longer))
        return [s for s in symbols if s is not None]

    def _ids(self, code: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The ids of each run of ``size`` symbols; a character without an id becomes its bytes."""
        odd = np.flatnonzero(code >= self.size)
        wide = np.ones(len(code), np.int64)
        data = [chr(c).encode() for c in (code[odd] - self.size).tolist()]
        wide[odd] = [len(d) for d in data]
        ids = np.repeat(code, wide)
        at = np.cumsum(wide) - wide
        ids[runs(at[odd], wide[odd])] = np.array(self.byte_id, np.int32)[np.frombuffer(b"".join(data), np.uint8)]
        packed = ids.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(wide)[np.cumsum(size) - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, segments: set[str]) -> None:
        short = [s for s in self.known.unknown(segments) if len(s) <= SHORT]
        if short:
            self.known.recent.update(zip(short, self._ids(*self._merged_side_by_side(short)), strict=True))

    def _by_heap(self, segment: str) -> bytes:
        code = np.array([self._code(s) for s in self.merged(segment)], np.int32)
        return self._ids(code, np.array([len(code)]))[0]

    def _segments(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The segments of all normalised texts, in order, and how many there are up to each text's begin
        and the last one's end."""
        whole = "".join(texts)
        begin = np.cumsum([0, *map(len, texts)])
        characters, places, data = [], [], []
        held, before = 0, self.kind[:1]
        for at in range(0, len(whole), BLOCK):
            block = whole[at : at + BLOCK]
            kind = self.kind[np.frombuffer(block.encode("utf-32-le"), np.uint32)]
            cut = self.cuts[np.concatenate([before, kind[:-1]]) * self.kinds + kind]
            cut[begin[(begin >= at) & (begin < at + len(block))] - at] = True
            cut = np.flatnonzero(cut)
            data.append(block.encode())
            starts = np.flatnonzero(np.frombuffer(data[-1], np.uint8) & 0xC0 != 0x80)  # of characters
            characters.append(at + cut)
            places.append(held + starts[cut])
            held, before = held + len(data[-1]), kind[-1:]
        characters = np.concatenate([*characters, begin[:0]])
        places = np.concatenate([*places, [held]]).astype(np.int64)
        segments = pa.LargeStringArray.from_buffers(len(characters), pa.py_buffer(places), pa.py_buffer(b"".join(data)))
        return segments, np.searchsorted(characters, begin)

    def encode(self, texts: list[str], ends: bool = True) -> list[np.ndarray]:
        """The ids of each whole text and, with ``ends``, the end id. Each distinct segment of the
        texts is looked up once."""
        segments, of_text = self._segments([self.library.normalize(t) for t in texts])
        segments = segments.dictionary_encode()
        which, names = segments.indices.to_numpy(), segments.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.known.recent.get, names)]
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            self._learn({names[i] for i in new})
            for i in new:
                found[i] = self.known.recent.get(names[i]) or self._by_heap(names[i])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(found), np.int32)[runs(begin[which], size[which])]
        at = np.concatenate([[0], np.cumsum(size[which])])[of_text]
        if ends:
            ids = np.insert(ids, at[1:], self.end)
            at += np.arange(len(at))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: without controls and the space in front; invalid bytes as U+FFFD."""
        return self.decode_all([ids])[0]

    def decode_all(self, texts: list[np.ndarray]) -> list[str]:
        """The text of each one's ids, as ``decode`` gives it."""
        ids = np.concatenate(texts)
        size = self.surface_size[ids]
        data = b"".join(
            self.surfaces[runs(self.surface_begin[ids[at : at + BLOCK]], size[at : at + BLOCK])].tobytes() for at in range(0, len(ids), BLOCK)
        )
        places = np.concatenate([[0], np.cumsum(size)])
        of_text = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        shown = np.append(np.flatnonzero(self.plain[ids]), len(ids))
        first = shown[np.searchsorted(shown, of_text[:-1])]  # of each text or a later one, of the former only where inside
        inside = first < of_text[1:]
        at, end = places[of_text[:-1]], places[of_text[1:]]
        if self.prefixed:
            first = first[inside]
            at[inside] += self.spaced[ids[first]] & (places[first] == at[inside])
        out = []
        for k, (a, b) in enumerate(zip(at.tolist(), end.tolist(), strict=True)):
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_odd(texts[k], int(a > places[of_text[k]])))
        return out

    def _decode_odd(self, ids: np.ndarray, dropped: int) -> str:
        """The text of ids with invalid bytes, without its first ``dropped`` bytes."""
        out, run = [], b""
        fallback = set(self.byte_id)
        for i in ids.tolist():
            piece = self.surface[i]
            if i in fallback:
                run += piece
            else:
                out += [_bytes_shown(run), piece[dropped:].decode()]
                run = b""
                dropped = 0 if piece else dropped
        return "".join([*out, _bytes_shown(run)])


def _bytes_shown(run: bytes) -> str:
    out = ""
    while run:
        for size in (1, 2, 3, 4):
            try:
                out += run[:size].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            out, size = out + "�", 1
        run = run[size:]
    return out


class Model:
    """The bytes of a model file; a worker makes the vocabulary of them once, for all its tasks."""

    def __init__(self, model_file: str):
        self.data = Path(model_file).read_bytes()
        self.made: MergeVocabulary | None = None

    def vocabulary(self) -> MergeVocabulary:
        if self.made is None:
            self.made = MergeVocabulary(self.data)
        return self.made


def encode_documents(docs: DataFrame, model_file: str, ends: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (array of int), decoded, agrees.

    Encodes each whole text with the merge-type vocabulary in ``model_file`` (with an end id if
    ``ends``) and decodes the ids again. Every text of every Arrow batch is also given to the
    sentencepiece library; ``agrees`` says whether its ids and its decoded text are the same.

    Null counts as the empty text, which has the end id only. A null or repeated doc_id stays as it
    is, an empty table gives no rows; only doc_id and text are read. The model file is read
    where the query is built and sent to the workers; its size does not depend on the documents.
    """
    small_batches(docs.sparkSession, 4 << 20)
    model = docs.sparkSession.sparkContext.broadcast(Model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.value.vocabulary()
        library = vocabulary.library
        for batch in batches:
            at = 0
            for part in by_size(raw_texts(batch), 1 << 20):
                texts = [t.decode("utf-8", "replace") for t in part]
                ids = vocabulary.encode(texts, ends)
                decoded = vocabulary.decode_all(ids)
                agrees = []
                for text, own, back in zip(texts, ids, decoded, strict=True):
                    theirs = library.encode(text, return_type="numpy", add_eos=ends)
                    agrees.append(np.array_equal(own, theirs) and library.decode(theirs) == back)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays = [
                    batch.column("doc_id").slice(at, len(part)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded", "agrees"])
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")
