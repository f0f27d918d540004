"""Alignment of two tokenizers' tokens, each distinct text once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortspark.llm.common import Memory, raw_texts, small_batches
from cohortspark.llm.quality import by_size
from cohortspark.session import materialize

PARTS = 256  # a text with more than 1 / PARTS of all rows is joined apart from the others
LINKS_AT_ONCE = 1 << 18
WORDS = 3 << 16  # twice as many distinct words have their ids remembered by a worker
BLOCK = 1 << 12  # new words that are encoded as one text
LOOSE_SPACE = re.compile(r" (?!\S)").search
LOOSE_WORDS = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*(?:\s+\Z)?|\s+").findall


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: the printable ones of
    Latin-1 stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Tokenizers A (byte level) and B (pieces), and the bytes of their tokens."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.a = Tokenizer.from_buffer(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=second)
        alphabet = byte_alphabet()
        self.bytes_a = [
            bytes(alphabet[c] for c in token) if set(token) <= alphabet.keys() else token.encode()
            for token in map(self.a.id_to_token, range(self.a.get_vocab_size()))
        ]
        self.bytes_b = [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))
        ]
        self.length_a, self.length_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # a piece with a space after something else would join two words
        self.parted = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.known: Memory[tuple[bytes, ...]] = Memory(WORDS)

    def words(self, text: str) -> list[str]:
        """``text`` cut at single spaces where no token of A or B reaches across: words of A start with at most one space,
        and a space between two others starts a word. A space next to white space stays inside a word."""
        if not self.parted:
            return [text]
        spaced = " " + text
        return [w[1:] for w in LOOSE_WORDS(spaced)] if LOOSE_SPACE(spaced) else text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (32 bits each) of space + text by A and of text by B; none where their bytes are not space + text."""
        # the pieces of B spell what its normaliser gives
        cut = [self.words(t) if t and self.b.normalize(t).replace("▁", " ") == " " + t else [] for t in texts]
        for word, ids in self._made([*self.known.unknown(set(chain.from_iterable(cut)))]):
            self.known.recent[word] = ids
        out = []
        for words in cut:
            found = [*map(self.known.recent.__getitem__, words)]
            out.append(tuple(b"".join([ids[side] for ids in found]) for side in (0, 1)) if all(found) else (b"", b""))
        self.known.trim()
        return out

    def _made(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, ...]]]:
        """Each word and its ids by A and B; an empty tuple where their bytes are not space + word."""
        plain = [w for w in words if not w[0].isspace() and w[-1] != " "]
        for begin in range(0, len(plain), BLOCK):
            yield from self._together(plain[begin : begin + BLOCK])
        for word in set(words).difference(plain) if len(plain) < len(words) else ():
            yield word, self._alone(word)

    def _ids(self, text: str) -> tuple[np.ndarray, ...]:
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        whole = b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return (np.array(a, np.int32), np.array(b, np.int32)) if same else ()

    def _alone(self, word: str) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in self._ids(word))

    def _together(self, words: list[str]) -> Iterable[tuple[str, tuple[bytes, ...]]]:
        """The ids of words as one text has them, cut where the words end."""
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        sides = []
        for ids, length in zip(self._ids(" ".join(words)), (self.length_a, self.length_b), strict=False):
            ends = np.cumsum(length[ids])
            last = np.searchsorted(ends, stops)
            if (ends[last] == stops).all():
                packed, at = ids.tobytes(), (4 * last + 4).tolist()
                sides.append([packed[s:e] for s, e in zip([0, *at[:-1]], at, strict=True)])
        if len(sides) < 2:  # a word is not given back byte by byte
            return [(w, self._alone(w)) for w in words]
        return zip(words, zip(*sides, strict=True), strict=True)


class Files:
    """The bytes of both files; a worker makes the tokenizers of them once, for all its tasks."""

    def __init__(self, first_file: str, second_file: str):
        self.data = Path(first_file).read_bytes(), Path(second_file).read_bytes()
        self.made: Tokenizers | None = None

    def tokenizers(self) -> Tokenizers:
        if self.made is None:
            self.made = Tokenizers(*self.data)
        return self.made


def _lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and where each row ends."""
    lists = batch.column(column)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return lists.flatten().to_numpy(zero_copy_only=False), ends


def links(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the tokens whose byte ranges end together. Rows may follow one another:
    both sides of a row have the same bytes, so the rows' ends meet."""
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    j = np.searchsorted(ends_b, ends_a)
    together = ends_b[np.minimum(j, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(a), bool)
    return np.flatnonzero(together), j[together]


class Alignment:
    """Documents whose texts are tokenised by A and B.

    ``texts``: one row per distinct text with ``key`` (its SHA-256), ``copies``, ``a`` and ``b``
    (arrays of ids, empty where A and B do not both give space + text). Texts are grouped as a whole,
    with partial counts, so that each is tokenised once however often it occurs.
    """

    def __init__(self, docs: DataFrame, first_file: str, second_file: str):
        spark = docs.sparkSession
        small_batches(spark, 4 << 20)
        # sizes of vocabularies, not of the documents
        self.files: Broadcast = spark.sparkContext.broadcast(Files(first_file, second_file))
        sizes = Tokenizers(*Files(first_file, second_file).data)
        self.lengths: Broadcast = spark.sparkContext.broadcast((sizes.length_a, sizes.length_b))
        files = self.files
        text = F.coalesce(F.col("text"), F.lit(""))
        key = F.unhex(F.sha2(text, 256)).alias("key")
        self.ids = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key), "ids")
        distinct = docs.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

        def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = files.value.tokenizers()
            for batch in batches:
                at = 0
                for part in by_size(raw_texts(batch), 1 << 20):
                    found = both.encode([t.decode("utf-8", "replace") for t in part])
                    arrays = [batch.column(c).slice(at, len(part)) for c in ("key", "copies")]
                    for side in zip(*found, strict=True):
                        ends = np.cumsum([0, *map(len, side)]) // 4
                        arrays.append(pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(side), np.int32)))
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "copies", "a", "b"])
                    at += len(part)

        rows = distinct.select(key, "copies", "text").mapInArrow(tokenise, "key binary, copies long, a array<int>, b array<int>")
        self.texts = materialize(rows, "tokens")

    def pairs(self) -> DataFrame:
        """a, b, n (links of this pair of ids in all documents), best (whether no pair with the same b has more).

        Of two tokens that end together the shorter one's bytes end the longer one's, and every end of a
        token is at most one token of the other vocabulary (two, where a byte has a token of its own twice).
        So there are at most twice as many pairs as the tokens of both vocabularies have bytes.
        """
        lengths = self.lengths

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, ends = _lists(batch, "a")
                b, _ = _lists(batch, "b")
                i, j = links(a, b, *lengths.value)
                copies = batch.column("copies").to_numpy()[np.searchsorted(ends, i, side="right")]
                codes, place = np.unique(a[i].astype(np.int64) << 32 | b[j], return_inverse=True)
                n = np.zeros(len(codes), np.int64)
                np.add.at(n, place, copies)
                arrays = [pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "n"])

        counts = self.texts.select("copies", "a", "b").mapInArrow(count, "a int, b int, n long")
        counts = materialize(counts.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
        most = counts.groupBy("b").agg(F.max("n").alias("most"))
        return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))

    def measures(self) -> DataFrame:
        """One row per distinct text: key, copies, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

        ``groups`` has the ids between common ends as ``a1,a2|b1;a3|b2,b3``.
        """
        lengths, spark = self.lengths, self.texts.sparkSession
        table = self.pairs().toArrow()  # bounded by the vocabularies, see pairs()
        codes = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy()
        order = np.argsort(codes)
        best = table["best"].to_numpy(zero_copy_only=False)
        known = spark.sparkContext.broadcast((codes[order], table["n"].to_numpy()[order], best[order].astype(bool)))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # an id with what follows it: a comma inside a group, else the sign that ends its side
            sides = zip(lengths.value, (",|", ",;"), strict=True)
            shown = [f"{i}{sign}" for own, signs in sides for sign in signs for i in range(len(own))]
            for whole in batches:
                for batch in _slices(whole):
                    yield _measured(batch, *lengths.value, known.value, shown)

        schema = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        return self.texts.mapInArrow(measure, schema)

    def documents(self, measures: DataFrame) -> DataFrame:
        """One row per document: doc_id and the columns that ``measures`` has beside key and copies.

        A text with more than 1 / PARTS of all rows would be a hot key of this join. There are fewer than
        PARTS such texts, whatever the input; they are sent to the documents.
        """
        measures = materialize(measures, "measures")
        rows = measures.agg(F.sum("copies")).first()[0] or 0
        often = F.col("copies") * PARTS > rows
        hot, others = measures.filter(often).drop("copies"), measures.filter(~often).drop("copies")
        apart = self.ids.join(F.broadcast(hot), "key")
        rest = self.ids.join(F.broadcast(hot.select("key")), "key", "left_anti").join(others.hint("merge"), "key")
        return apart.unionByName(rest).drop("key")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in order, with about LINKS_AT_ONCE tokens or one row at once."""
    sizes = np.cumsum(batch.column("a").value_lengths().to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + LINKS_AT_ONCE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _measured(batch: pa.RecordBatch, length_a: np.ndarray, length_b: np.ndarray, known: tuple, shown: list[str]) -> pa.RecordBatch:
    rows = batch.num_rows
    a, ends_a = _lists(batch, "a")
    b, ends_b = _lists(batch, "b")
    i, j = links(a, b, length_a, length_b)
    row = np.searchsorted(ends_a, i, side="right")
    codes, counts, best = known
    at = np.searchsorted(codes, a[i].astype(np.int64) << 32 | b[j])
    n_links = np.bincount(row, minlength=rows)
    n_best = np.bincount(row, weights=best[at], minlength=rows).astype(np.int64)
    count_sum = np.zeros(rows, np.int64)
    np.add.at(count_sum, row, counts[at])
    # tokens of both sides by group, A first; the last of each side of a group is the linked one
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[i] = last_b[j] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    names = np.empty(len(a) + len(b), np.int64)
    # before a token stand those of its side and the other side's of earlier groups, for B of its own one too
    names[np.arange(len(a)) + np.append(0, j + 1)[group_a]] = a + last_a * len(length_a)
    names[np.arange(len(b)) + (i + 1)[group_b]] = b + 2 * len(length_a) + last_b * len(length_b)
    names = names.tolist()
    stops = [0, *(ends_a + ends_b).tolist()]
    groups = ["".join(map(shown.__getitem__, names[s:e]))[:-1] for s, e in zip(stops[:-1], stops[1:], strict=True)]
    n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    measures = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_links, n_links, n_best, count_sum)]
    names = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *measures, pa.array(groups, pa.string())], names)


def align(docs: DataFrame, first_file: str, second_file: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Space + text is encoded by the byte-level vocabulary ``first_file`` (A), text by the piece
    vocabulary ``second_file`` (B), without special tokens. Byte offsets where tokens of both end cut the tokens into
    groups; a link is a pair of tokens that end together. ``count_sum`` adds up how often each link's
    pair of ids is linked in all documents, ``n_best`` counts the links whose pair is the most frequent
    one of its B id (ties too).

    Null and empty texts, and texts that A and B do not both give back byte by byte, have no tokens: zeros and ''.
    Copies count as often as they occur. A null or repeated doc_id stays as it is; an empty table
    gives no rows; only doc_id and text are read.
    """
    found = Alignment(docs, first_file, second_file)
    return found.documents(found.measures())
