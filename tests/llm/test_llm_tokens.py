"""Token alignment, periodic runs and piece encoding against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import pairwise

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortspark.llm import alignment, periods, pieces
from cohortspark.llm.common import Memory, table
from cohortspark.llm.queries import QUERIES, with_period

DOCS = "doc_id bigint, text string, key string, a int, b int, step int, runs string, ids string, copies int"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(*row, "k", 1, 2, 3, "r", "i", 4) for row in rows], DOCS)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


ODD = [None, "", " ", "  ", "▁", "a▁b", "a\0b", "<|endoftext|> <s></s><unk><0x0A>", "日本語 😀�", "a" * 3000, " " * 300 + "x", "\n\n \t", "é ﬁ", "x y " * 2000]

# --- alignment -----------------------------------------------------------------------


def aligned(docs):
    """The contract's columns by loops over tokens, with offsets in sets."""
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=PIECES)
    alphabet = alignment.byte_alphabet()
    per_doc, counts = [], Counter()
    for doc_id, text in docs:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            bytes_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                a, b = [], []
            i = j = end_a = end_b = 0
            group = [], []
            while i < len(a) or j < len(b):
                if end_a <= end_b:
                    end_a, i = end_a + len(bytes_a[i]), i + 1
                    group[0].append(a[i - 1])
                else:
                    end_b, j = end_b + len(bytes_b[j]), j + 1
                    group[1].append(b[j - 1])
                if end_a == end_b:
                    links.append((a[i - 1], b[j - 1]))
                    groups.append("|".join(",".join(map(str, side)) for side in group))
                    group = [], []
        counts.update(links)
        per_doc.append((doc_id, a, b, links, ";".join(groups)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, len(a), len(b), len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), shown)
        for i, a, b, links, shown in per_doc
    ]


def test_alignment_equals_brute_force(spark, rows):
    draw = random.Random(5)
    docs = list(enumerate(ODD)) + [(100 + i, "".join(draw.choice("ab é\n日.the ") for _ in range(draw.randrange(60)))) for i in range(60)]
    docs += [(None, "the cat sat"), (None, None), (7, "the cat sat")] + [(1000 + i, "one text, many times") for i in range(50)]
    got = alignment.align(frame(spark, docs), BYTES, PIECES)
    assert rows(got) == sorted(aligned(docs), key=repr)


def test_alignment_of_no_rows(spark):
    assert alignment.align(frame(spark, [(1, "a")]).filter("doc_id > 1"), BYTES, PIECES).count() == 0


def test_alignment_query_equals_brute_force(spark, folder, rows):
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    want = [(*x[:-1], sha(x[-1]) if x[1] else "") for x in aligned(docs)]
    got = QUERIES["op11_token_alignment"](spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == sorted(want, key=repr)


def test_each_distinct_text_is_tokenised_once_and_pairs_are_bounded(spark):
    found = alignment.Alignment(frame(spark, [(i, "same text") for i in range(40)] + [(99, "other")]), BYTES, PIECES)
    assert sorted(r.copies for r in found.texts.select("copies").collect()) == [1, 40]
    both = alignment.Tokenizers(open(BYTES, "rb").read(), open(PIECES, "rb").read())
    assert found.pairs().count() <= 2 * (both.length_a.sum() + both.length_b.sum())


def plain_ids(both, text):
    """The ids of a whole text at once."""
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    same = b"".join(both.bytes_a[i] for i in a) == b"".join(both.bytes_b[i] for i in b) == b" " + text.encode()
    return (a, b) if text and same else ([], [])


def test_ids_by_words_equal_those_of_whole_texts():
    both = alignment.Tokenizers(open(BYTES, "rb").read(), open(PIECES, "rb").read())
    draw = random.Random(9)
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "'s", "!", "the", " the", "1", "é", "日", "▁", "\0", "\r\n", "<s>"]
    texts = [t or "" for t in ODD] + ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(3000)]
    for begin in range(0, len(texts), 100):
        part = texts[begin : begin + 100]
        for text, sides in zip(part, both.encode(part), strict=True):
            assert tuple(alignment.np.frombuffer(x, "int32").tolist() for x in sides) == plain_ids(both, text)


def test_a_word_that_returns_is_not_given_to_the_libraries_again():
    both = alignment.Tokenizers(open(BYTES, "rb").read(), open(PIECES, "rb").read())
    library, given = both.b, []

    class Counted:
        normalize = staticmethod(library.normalize)

        @staticmethod
        def encode(text):
            given.append(text)
            return library.encode(text)

    both.b = Counted
    texts = [" ".join(f"word{(i * k) % 50}" for k in range(200)) for i in range(1, 40)]
    both.encode(texts[:20])
    both.encode(texts[20:])
    assert sorted(w for text in given for w in text.split()) == sorted({w for text in texts for w in text.split()})


def test_memory_keeps_what_returns_and_stays_bounded():
    memory = Memory(10, longest=5)
    for k in range(100):
        names = {"often", f"n{k}", f"long name {k}"}
        new = memory.unknown(names)
        assert new == names - ({"often"} if k else set())
        memory.recent.update((name, name) for name in new)
        assert all(memory.recent[name] == name for name in names)
        memory.trim()
        assert len(memory.recent) <= 13 and len(memory.older) <= 13 and not any(len(n) > 5 for n in memory.recent)


# --- periodic runs -------------------------------------------------------------------


def all_runs(words):
    """Every period's maximal stretches, smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                length = i - start + q
                if length >= max(24, 3 * q):
                    found.setdefault((start, length), q)
                start = None
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def by_tiles(words):
    """The runs of one text by tiles, stitched without Spark."""
    intervals = {}
    for step, begin, bits, part in periods._tiles(periods._codes(words)):
        first = -(-begin // step) + (begin > 0)
        for q, lo, hi in periods.tile_fragments(part.tolist(), begin, step, [first + k for k in range(periods.GROUP) if bits >> k & 1]):
            intervals.setdefault(q, []).append((lo, hi))
    out = []
    for q, pieces_of in intervals.items():
        merged = []
        for lo, hi in sorted(pieces_of):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        out += [(lo, hi - lo + q, q) for lo, hi in merged if hi - lo + q >= max(24, 3 * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    words = draw(st.lists(st.sampled_from("ab"), max_size=30))
    for _ in range(draw(st.integers(1, 4))):
        block = draw(st.lists(st.sampled_from("abc"), min_size=1, max_size=draw(st.sampled_from([2, 9, 40]))))
        words = words + block * draw(st.integers(1, 9))
        if draw(st.booleans()):
            words = words * draw(st.integers(1, 4))
    return [w.encode() for w in words[:900]]


@settings(max_examples=150, deadline=None)
@given(repetitive())
def test_tiles_find_all_runs(words):
    assert by_tiles(words) == sorted(all_runs(words), key=lambda r: (r[0], r[2]))


def test_z_function():
    draw = random.Random(2)
    for _ in range(100):
        s = [draw.randrange(2) for _ in range(draw.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) if i else 0 for i in range(len(s))]
        assert periods.z_function(s) == want


def expected(doc_id, text, rewrite=None):
    words = (text or "").encode().split()
    words = rewrite(doc_id, words) if rewrite else words
    runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return words, runs, top, collapsed(words, runs)


def test_runs_of_odd_documents(spark):
    draw = random.Random(8)
    long = " ".join(draw.choice("abc") for _ in range(3000))
    docs = list(enumerate([*ODD, long, "a b c " * 700 + long[:900] + " x" * 500, "p q " * 30 + "q p q " * 20, "w " * 23, "w " * 24]))
    docs += [(None, "a b " * 20), (None, "z"), (3, "a b " * 20)]
    got = periods.periodic_runs(frame(spark, docs), texts=True).collect()
    assert all(r.collapsed_sha256 == sha(r.collapsed) for r in got)
    simple = lambda r: (r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.top and tuple(r.top), r.collapsed)
    want = []
    for i, text in docs:
        words, runs, top, kept = expected(i, text)
        want.append((i, len(words), tuple(runs), top, kept.decode()))
    assert sorted(map(simple, got), key=repr) == sorted(want, key=repr)


def test_runs_of_no_rows(spark):
    assert periods.periodic_runs(frame(spark, [(1, "a")]).filter("doc_id > 1")).count() == 0


def test_period_query_equals_brute_force(spark, folder):
    docs = table(spark, folder, "documents").filter("length(text) < 20000 or text is null")
    got = {r.doc_id: r for r in QUERIES["op12_period_tiles"](spark, folder).collect()}
    planted = 0
    for r in docs.collect():
        words, runs, top, kept = expected(r.doc_id, r.text, with_period)
        own = got[r.doc_id]
        planted += zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and bool(runs)
        shown = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert (own.n_runs, own.runs_sha256, own.collapsed_sha256) == (len(runs), sha(shown), sha(kept))
        assert (own.start, own.length, own.period) == (top or (None,) * 3)
        assert own.exponent_milli == (1000 * top[1] // top[2] if top else None)
    assert planted > 5 and len(got) == table(spark, folder, "documents").count()


def test_fragments_of_a_long_run_are_stitched_without_one_row_per_word(spark):
    words = [b"a", b"b"] * 40_000
    tiles = list(periods._tiles(periods._codes(words)))
    assert sum(len(t[3]) for t in tiles) < 2 * len(words) * len(periods.octaves(len(words)))
    assert by_tiles(words) == [(0, 80_000, 2)]


# --- pieces --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECES, "rb") as file:
        return pieces.MergeVocabulary(file.read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab the▁\n日é😀<s>\0​ﬁ.,", max_size=50) | st.text(max_size=20), max_size=4))
def test_agenda_equals_the_library(vocabulary, texts):
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        theirs = vocabulary.library.encode(text, add_eos=True)
        assert ids.tolist() == theirs and vocabulary.decode(ids) == vocabulary.library.decode(theirs)


def test_a_worker_makes_one_vocabulary_and_keeps_what_it_learned(vocabulary):
    model = pieces.Model(PIECES)
    assert model.vocabulary() is model.vocabulary()
    own, learned = model.vocabulary(), []
    learn = own._learn
    own._learn = lambda words: (learned.extend(words), learn(words))
    texts = ["the cat sat on the mat", "the mat,\nthe cat", "日本語" * 50 + " the cat", "x" * 100 + " y" * 3, " the  cat ", ""]
    for _ in range(3):
        for part in (texts[:3], texts[3:]):
            assert [x.tolist() for x in own.encode(part)] == [vocabulary.library.encode(t, add_eos=True) for t in part]
    short = [w for w in learned if len(w) <= pieces.SHORT]
    assert len(short) == len(set(short)) and not any(len(w) > pieces.SHORT for w in own.known.recent)


def test_each_distinct_segment_of_a_part_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    own = pieces.Model(PIECES).vocabulary()
    texts = ["the cat, the hat. " * 500, "", "the cat the\n" * 300]
    want = [own.library.encode(t, add_eos=True) for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == want
    own.known.recent = Counted(own.known.recent)
    assert [x.tolist() for x in own.encode(texts)] == want
    assert Counted.asked < 20


def test_texts_are_cut_wherever_no_piece_has_the_two_characters(vocabulary):
    inside = {p[k : k + 2] for p in vocabulary.id for k in range(len(p) - 1)}
    texts = ["▁the▁cat,▁日本.▁▁▁x\0▁", "", "t", "é😀th"]
    want = []
    for t in texts:
        segment = t[:1]
        for pair in map("".join, pairwise(t)):
            if pair in inside:
                segment += pair[1]
            else:
                want.append(segment)
                segment = pair[1]
        want += [segment] * bool(t)
    segments, of_text = vocabulary._segments(texts)
    assert segments.to_pylist() == want
    assert ["".join(want[a:b]) for a, b in pairwise(of_text.tolist())] == texts


@pytest.mark.parametrize(("name", "value"), [("BLOCK", 1), ("BLOCK", 7), ("KINDS", 2), ("KINDS", 30), ("WIDTHS", (1, 2))])
def test_limits_of_blocks_kinds_and_widths_change_no_result(monkeypatch, vocabulary, name, value):
    monkeypatch.setattr(pieces, name, value)
    own = pieces.Model(PIECES).vocabulary()
    texts = [*(t or "" for t in ODD), "the cat,\nthe  hat é日😀" * 9, "", "onionheréationing" * 9]
    want = [vocabulary.library.encode(t, add_eos=True) for t in texts]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == want
    assert own.decode_all(ids) == [vocabulary.library.decode(x) for x in want]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 60) | st.integers(0, 2**53), st.integers(0, 40_000)), st.lists(st.integers(0, 60)))
def test_pair_table_equals_a_dictionary(values, asked):
    table_ = pieces.PairTable(pieces.np.array([*values], "int64"), pieces.np.array([*values.values()], "int32"))
    asked = [*asked, *values]
    assert table_.find(pieces.np.array(asked, "int64")).tolist() == [values.get(x, -1) for x in asked]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=8), min_size=1, max_size=5))
def test_decoding_many_texts_equals_the_library(vocabulary, texts):
    assert vocabulary.decode_all([pieces.np.array(x, "int32") for x in texts]) == [vocabulary.library.decode(x) for x in texts]


def test_heap_and_arrays_merge_alike(vocabulary):
    draw = random.Random(4)
    segments = ["▁" + "".join(draw.choice("theinganosr") for _ in range(draw.randrange(1, 40))) for _ in range(300)]
    side_by_side = vocabulary._ids(*vocabulary._merged_side_by_side(segments))
    assert side_by_side == [vocabulary._by_heap(s) for s in segments]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=8))
def test_decoding_any_ids_equals_the_library(vocabulary, ids):
    assert vocabulary.decode(pieces.np.array(ids, "int32")) == vocabulary.library.decode(ids)


def test_piece_query_equals_the_library(spark, folder, rows, vocabulary):
    library, want = vocabulary.library, []
    for r in table(spark, folder, "documents").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True))
    assert rows(QUERIES["op13_piece_agenda"](spark, folder)) == sorted(want, key=repr)


def test_pieces_without_ends(spark, vocabulary):
    docs = [*enumerate(ODD)]
    got = pieces.encode_documents(frame(spark, docs), PIECES, ends=False).collect()
    want = [(i, vocabulary.library.encode(t or "")) for i, t in docs]
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want and all(r.agrees for r in got)
    alone = pieces.encode_documents(frame(spark, [(0, None)]), PIECES, ends=False).collect()
    assert [(list(r.ids), r.decoded, r.agrees) for r in alone] == [([], "", True)]


def test_pieces_of_odd_documents(spark, vocabulary):
    docs = [*enumerate(ODD), (None, "a"), (None, None), (1, "a")]
    got = pieces.encode_documents(frame(spark, docs), PIECES).collect()
    want = [(i, vocabulary.library.encode(t or "", add_eos=True)) for i, t in docs]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr) and all(r.agrees for r in got)
    assert pieces.encode_documents(frame(spark, docs[:1]).filter("doc_id > 5"), PIECES).count() == 0
