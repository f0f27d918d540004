"""Language-model scores from an n-gram trie over the whole training corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import elias_fano
from cohortspark.llm.common import mix64, raw_texts, small_batches
from cohortspark.llm.elias_fano import MappedLevel, TrieLevel
from cohortspark.llm.labelled import remainder
from cohortspark.session import materialize

PACK_BYTES = 8 << 20  # of texts in a pack
SHARD_TOKENS = 2_500_000  # tokens per shard of the trie
PRIOR = 10.0  # weight of the unigram model in a context
STEP = 1.06  # least ratio of adjacent quantised counts
EDGE = 0  # the id that ends every text and is the context of its first word


def step_for(largest: int) -> float:
    """The ratio with which one byte reaches counts up to ``largest``: STEP, or more where it ends
    below (1.06 up to 2.6 million, 1.08 up to 300 million, 1.11 up to 3e11)."""
    return max(STEP, float(max(largest, 1)) ** (1 / 254))


def quantised(counts: np.ndarray, step: float = STEP) -> np.ndarray:
    """Counts as one byte: 0 for none, else 1 + the rounded logarithm to base ``step``."""
    codes = np.where(counts > 0, 1 + np.rint(np.log(np.maximum(counts, 1)) / np.log(step)), 0)
    if len(codes) and codes.max() > 255:
        raise ValueError(f"step {step} is too small for a count of {counts.max()}")
    return codes.astype(np.uint8)


def restored(codes: np.ndarray, step: float = STEP) -> np.ndarray:
    return np.where(codes > 0, step ** (codes.astype(np.float64) - 1), 0.0)


def packs(docs: DataFrame, modulus: int, held_out: int, pack_bytes: int) -> DataFrame:
    """Documents in packs of about ``pack_bytes``: pack, doc_ids, held, learn, counts (words of each),
    tokens (of all), hashes (of the distinct lower-cased words) and codes (which of them stands at
    each place, compressed)."""
    small_batches(docs.sparkSession)
    rest = remainder(F.col("doc_id"), modulus)
    flags = [F.coalesce(rest == held_out, F.lit(False)).alias("held"), F.coalesce(rest != held_out, F.lit(False)).alias("learn")]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", *flags, "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, size = 0, 0
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            counts = [len(r[3]) for r in rows]
            column = np.empty(sum(counts), dtype=object)
            column[:] = [w for r in rows for w in r[3]]
            codes, distinct = pd.factorize(column)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
            # words come in the order they are first met, so the upper bytes are mostly zeros
            planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            columns = [first + number, *([r[i] for r in rows] for i in range(3)), counts, sum(counts),
                       hashes.astype("<u8").tobytes(), zstandard.compress(planes, 3)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()),
                     pa.int64(), pa.binary(), pa.binary()]
            names = ["pack", "doc_ids", "held", "learn", "counts", "tokens", "hashes", "codes"]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "held", "learn"))
            for doc_id, held, learn, text in zip(*columns, raw_texts(batch), strict=True):
                rows.append((doc_id, held, learn, text.lower().split()))
                size += len(text) + 64
                if size >= pack_bytes:
                    yield packed()
                    rows, size, number = [], 0, number + 1
        if rows:
            yield packed()

    schema = (
        "pack long, doc_ids array<long>, held array<boolean>, learn array<boolean>, counts array<long>, tokens long, "
        "hashes binary, codes binary"
    )
    return picked.mapInArrow(pack, schema)


class Pack:
    """The words of a pack as numbers of distinct words, which are sorted by hash."""

    def __init__(self, row: dict):
        self.counts = np.array(row["counts"], np.int64)
        planes = np.frombuffer(zstandard.decompress(row["codes"]), np.uint8).reshape(4, -1)
        codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
        hashes = np.frombuffer(row["hashes"], "<u8")
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes, self.codes = hashes[order], place[codes]
        self.learn = np.array(row["learn"], bool)

    def word_counts(self) -> np.ndarray:
        """How often each distinct word stands in the texts to learn from."""
        return np.bincount(self.codes[np.repeat(self.learn, self.counts)], minlength=len(self.hashes))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (context, word) of numbers + 1 with 0 for the edges, how often each is
        to be learned, and the pair at every token, the end of each text included."""
        ends = np.cumsum(self.counts + 1) - 1
        word = np.zeros(len(self.codes) + len(self.counts), np.int64)
        inside = np.ones(len(word), bool)
        inside[ends] = False
        word[inside] = self.codes + 1
        context = np.concatenate([[0], word[:-1]])
        span = len(self.hashes) + 1
        distinct, at = np.unique(context * span + word, return_inverse=True)
        learned = np.bincount(at[np.repeat(self.learn, self.counts + 1)], minlength=len(distinct))
        return distinct // span, distinct % span, learned, at


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper half of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shards(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """By both ids, so that a word that follows or precedes everything is spread over all shards."""
    return shard_of(mix64(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.uint64)), shards)


def _slices(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the runs of a sorted column."""
    begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    return list(zip(shard[begins].tolist(), begins.tolist(), np.append(begins[1:], len(shard)).tolist(), strict=True))


def _small(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<i8").tobytes(), 3)


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i8")


PART = "shard long, pack long, level binary, numbers binary"
ANSWER = "shard long, pack long, ranks binary, numbers binary, size long, total long"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def unigram_level(packed: DataFrame, shards: int) -> DataFrame:
    """Level 1: for each pack and shard the rank (Elias-Fano) and training count of the pack's words
    among all words of the shard. One row per shard has pack -1 with its words known from
    training (size), their tokens (total), its number of words (ranks) and their largest count
    (numbers)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                n = pack.word_counts()
                cut = _slices(shard_of(pack.hashes, shards))
                # one bit less keeps a hash within a signed integer
                yield _rows([(s, row["pack"], elias_fano.encode(pack.hashes[a:b] >> np.uint64(1)), _small(n[a:b])) for s, a, b in cut], PART)

    def count(group: pa.Table) -> pa.Table:
        parts = [elias_fano.decode(x)[0] for x in group["level"].to_pylist()]
        n = [_large(x) for x in group["numbers"].to_pylist()]
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, np.concatenate(n)).astype(np.int64)
        shard, rows, begin = group["shard"][0].as_py(), [], 0
        for pack, part in zip(group["pack"].to_pylist(), parts, strict=True):
            ranks = at[begin : begin + len(part)]
            begin += len(part)
            rows.append((shard, pack, elias_fano.encode(ranks), _small(total[ranks]), None, None))
        rows.append((shard, -1, elias_fano.encode(np.array([len(distinct)])), _small(total.max(initial=0, keepdims=True)), int((total > 0).sum()), int(total.sum())))
        return pa.Table.from_batches([_rows(rows, ANSWER)])

    return packed.mapInArrow(send, PART).groupBy("shard").applyInArrow(count, ANSWER)


def _answers(table: DataFrame, name: str) -> DataFrame:
    """All answers for one pack in one row; they are as large as the pack's own words."""
    fields = [c for c in table.columns if c not in ("pack", "size", "total")]
    return table.filter("pack >= 0").groupBy("pack").agg(F.collect_list(F.struct(*fields)).alias(name))


def _word_ids(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Global ids and training counts of a pack's distinct words: rank * shards + shard + 1, with
    the edge's id in front of them."""
    ids, n = [np.array([EDGE])], [np.array([0])]
    for answer in sorted(row["words_known"] or [], key=lambda x: x["shard"]):
        ids.append(elias_fano.decode(answer["ranks"])[0] * shards + answer["shard"] + 1)
        n.append(_large(answer["numbers"]))
    return np.concatenate(ids), np.concatenate(n)


def _sorted_pairs(pack: Pack, ids: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of global ids by shard, context and word: shard, context, word, learned, and
    for every token the place of its pair."""
    context, word, learned, at = pack.pairs()
    context, word = ids[context], ids[word]
    shard = pair_shards(context, word, shards)
    order = np.lexsort((word, context, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return shard[order], context[order], word[order], learned[order], place[at]


def bigram_level(packed: DataFrame, shards: int, vocabulary: int, step: float) -> DataFrame:
    """Level 2: for each pack and shard one byte for each of the pack's pairs: the quantised
    training count in the whole corpus, found in the shard's trie. The trie lives as long as its
    shard is asked; nothing reads it afterwards, so it is not written."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _ = _word_ids(row, shards)
                shard, context, word, learned, _ = _sorted_pairs(Pack(row), ids, shards)
                yield _rows([
                    (s, row["pack"], TrieLevel.build(context[a:b], word[a:b], vocabulary), _small(learned[a:b]))
                    for s, a, b in _slices(shard)
                ], PART)

    def count(group: pa.Table) -> pa.Table:
        parts = [TrieLevel.read(x, vocabulary)[:2] for x in group["level"].to_pylist()]
        n = np.concatenate([_large(x) for x in group["numbers"].to_pylist()])
        context, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        learned = np.flatnonzero(n)
        order = learned[np.lexsort((word[learned], context[learned]))]
        c, w = context[order], word[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        total = np.add.reduceat(n[order], np.flatnonzero(new)) if len(c) else np.empty(0, np.int64)
        level, codes = TrieLevel.build(c[new], w[new], vocabulary), quantised(total, step).tobytes()
        trie = MappedLevel(level, codes, vocabulary)
        shard, rows = group["shard"][0].as_py(), []
        for pack, (own_context, own_word) in zip(group["pack"].to_pylist(), parts, strict=True):
            rows.append((shard, pack, None, trie.find(own_context, own_word).tobytes(), None, None))
        trie.close()
        return pa.Table.from_batches([_rows(rows, ANSWER)])

    return packed.mapInArrow(send, PART).groupBy("shard").applyInArrow(count, ANSWER)


def score_documents(
    docs: DataFrame, modulus: int = 7, held_out: int = 2, pack_bytes: int = PACK_BYTES, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (white space between them, A-Z as a-z) and one end. Counts are of
    all texts whose crc32 remainder is not ``held_out``; base_score is the add-one unigram
    log10 probability and score that of the bigram model: in a context that was seen c times, a
    word that followed it k times has (k + PRIOR * base) / (c + PRIOR), with k quantised to
    one byte whose steps (``step_for``) reach the most frequent word of the corpus. Null counts as the empty text (one end); a null doc_id is neither held out nor
    learned from; repeated rows are learned from each; an empty table gives no rows.

    Texts are packed. A pack sends its distinct words and pairs, coded as small tries, to
    shards; a shard adds up all packs, builds its part of the trie and answers each pack in the
    order of its own trie. Neither words nor pairs are rows of their own, and a frequent word
    is one entry per pack.
    """
    packed = materialize(packs(docs, modulus, held_out, pack_bytes), "packs")
    sums = packed.agg(
        F.sum("tokens"), F.sum(F.expr("size(filter(learn, x -> x))")).alias("ends")
    ).first()
    tokens, ends = sums[0] or 0, sums[1] or 0
    shards = max(8, -(-tokens // shard_tokens))
    words = materialize(unigram_level(packed, shards), "words")
    last = lambda x: elias_fano.decode(x)[0]
    largest, known, total, most = _shard_sums(words, last)
    step = step_for(max(most, ends))  # a pair is no more frequent than its words
    vocabulary = int(largest + 1) * shards + 1
    train_tokens, distinct = total + ends, known + (ends > 0)
    both = packed.join(_answers(words, "words_known").hint("merge"), "pack", "left")
    pairs = materialize(bigram_level(both, shards, vocabulary, step), "pairs")
    all_three = both.join(_answers(pairs.drop("ranks"), "pairs_known").hint("merge"), "pack", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                ids, n = _word_ids(row, shards)
                n[EDGE] = ends
                answers = sorted(row["pairs_known"] or [], key=lambda x: x["shard"])
                _, context, word, _, place = _sorted_pairs(pack, ids, shards)
                followed = restored(np.frombuffer(b"".join(a["numbers"] for a in answers), np.uint8), step)
                by_id = np.argsort(ids)
                seen = n[by_id[np.searchsorted(ids[by_id], context)]]
                count = n[by_id[np.searchsorted(ids[by_id], word)]]
                base = (count + 1) / (train_tokens + distinct + 1)
                chance = (followed + PRIOR * base) / (np.maximum(seen, followed) + PRIOR)
                doc = np.repeat(np.arange(len(pack.counts)), pack.counts + 1)
                add = lambda x: np.bincount(doc, x[place], len(pack.counts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()),
                    pa.array(pack.counts + 1, pa.int64()), pa.array(add(count > 0).astype(np.int64)),
                    pa.array(np.full(len(pack.counts), train_tokens, np.int64)),
                    pa.array(add(np.log10(base))), pa.array(add(np.log10(chance))),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return all_three.mapInArrow(score, schema)


def _shard_sums(words: DataFrame, decode) -> tuple[int, int, int, int]:
    """Words of the largest shard, words and tokens known from training, the largest count."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(decode(x)[0]) for x in batch.column("ranks").to_pylist()]
            most = [int(_large(x)[0]) for x in batch.column("numbers").to_pylist()]
            columns = [pa.array(n, pa.int64()), batch.column("size"), batch.column("total"), pa.array(most, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["n", "size", "total", "most"])

    own = words.filter("pack = -1").select("ranks", "size", "total", "numbers")
    own = own.mapInArrow(sizes, "n long, size long, total long, most long")
    return tuple(x or 0 for x in own.agg(F.max("n"), F.sum("size"), F.sum("total"), F.max("most")).first())
