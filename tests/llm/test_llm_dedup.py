"""Exact, near, line and byte-string dedup against brute force on small fixtures."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import exact, lines, repeats, setsketch
from cohortspark.llm.components import components
from cohortspark.llm.suffix import permuted_lcp, suffix_array

DOCS = "doc_id bigint, text string, _key string, name string, h string, pos int"


def frame(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(*row, "k", "n", "h", 1) for row in rows], DOCS)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- exact ---------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 4, 2048])
def test_exact_dedup_equals_grouping_by_text(spark, block):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(0, 9))) for _ in range(120)]
    texts += ["", None, "aaaa", "aaaaaaaa", "aaaab", "é" * 5, "é" * 6]
    got = exact.exact_dedup(frame(spark, list(enumerate(texts))), block).collect()
    groups = defaultdict(list)
    for i, text in enumerate(texts):
        groups[text or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), sha(text)) for text, g in groups.items() for i in g}
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(texts)


def test_exact_dedup_of_repeated_rows_and_missing_ids(spark, rows):
    docs = frame(spark, [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, "y")])
    got = rows(exact.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert Counter(got) == Counter([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (None, 2, 2, False), (2, 2, 2, True)])
    kept = exact.kept_documents(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text", "_key") == [(1, "x", "k"), (2, "y", "k")]


def test_blocks_with_equal_hashes_keep_different_names(spark):
    blocks = spark.createDataFrame([(1, bytearray(b"a"), 7), (2, bytearray(b"b"), 7), (3, bytearray(b"a"), 7)],
                                   "_key bigint, block binary, h bigint")
    names = {r["_key"]: r["name"] for r in exact._named_blocks(blocks).collect()}
    assert names[1] == names[3] != names[2]


# --- lines ---------------------------------------------------------------------------


def brute_lines(texts, min_docs, min_chars):
    key = lambda line: line.encode().strip().lower().decode()
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= min_chars and found[key(x)] >= min_docs)]
        out.append((len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


@pytest.mark.parametrize(("min_docs", "min_chars", "batches"), [(3, 1, 4), (2, 3, 9), (10, 1, 1)])
def test_line_dedup_equals_counting_lines(spark, min_docs, min_chars, batches):
    draw = random.Random(min_docs)
    pool = ["A line", " a LINE\t", "é", "É", "b ", "x", "", "  ", "c c", "\x1cd", "long " * 40]
    texts = ["\n".join(draw.choice(pool + [str(draw.random())]) for _ in range(draw.randrange(1, 7))) for _ in range(60)]
    texts += [None, "", "\n\n", "A line\n" * 50]
    got = lines.line_dedup(frame(spark, list(enumerate(texts))), min_docs, min_chars, batches, texts=True).collect()
    want = brute_lines(texts, min_docs, min_chars)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == dict(enumerate(want))
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


def test_runs_are_compacted_and_settled_keys_stay_out(spark, rows):
    runs = lines.LineRuns(min_docs=3, fanout=2)
    batch = lambda *keys: spark.createDataFrame([(k, k, n) for k, n in keys], "h1 bigint, h2 bigint, n bigint")
    for keys in ([(1, 2), (2, 1)], [(1, 1), (3, 1)], [(1, 5), (2, 1)], [(2, 1), (4, 1)], [(3, 1), (5, 1)]):
        runs.add(batch(*keys))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    later = [key for level in runs.levels for run in level for key in rows(run, "h1")]
    assert (1,) not in later  # reached three documents in the first merge
    assert rows(runs.frequent(), "h1") == [(1,), (2,)]


def test_later_batches_of_the_query_are_anti_joined(spark, monkeypatch):
    plans, sizes, write = [], [], lines.materialize

    def noting(df, label):
        out = write(df, label)
        if label == "run":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            sizes.append(out.filter("n > 1").count())
        return out

    monkeypatch.setattr(lines, "materialize", noting)
    rows = [(i, f"everywhere\nonly {i}\nevery {i % 40}") for i in range(400)]
    got = lines.line_dedup(frame(spark, rows))
    assert {r.n_dropped for r in got.collect()} == {2}
    assert ["LeftAnti" in plan for plan in plans] == [False, True, True, True, False]  # four batches and their compaction
    assert sizes[3] < sizes[0]


# --- byte strings --------------------------------------------------------------------


def test_suffix_arrays_equal_sorted_suffixes():
    draw = np.random.default_rng(1)
    for round_ in range(150):
        n, k = draw.integers(1, 50), draw.integers(1, 5)
        text = draw.integers(1, k + 1, n)
        text = np.append(np.tile(text[:4], 9) if round_ % 3 == 0 else text, 0).astype(np.uint16)
        own = text.tolist()
        want = sorted(range(len(own)), key=lambda i: own[i:])
        suffixes = suffix_array(text, k + 1)
        assert suffixes.tolist() == want
        before, shared = permuted_lcp(text, suffixes)
        for a, b in zip(want, want[1:], strict=False):
            both = 0
            while max(a, b) + both < len(own) and own[a + both] == own[b + both]:
                both += 1
            assert before[b] == a and shared[b] == both


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    found = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if found[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((len(d), int(gone.sum()), runs, sha(np.frombuffer(d, np.uint8)[~gone].tobytes())))
    return out


@pytest.mark.parametrize(("large_group", "piece"), [(4000, 1 << 20), (1, 1 << 20), (4000, 64), (2, 50)])
def test_repeats_equal_counting_all_strings(spark, monkeypatch, large_group, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 300)
    draw = random.Random(large_group + piece)
    word = lambda n: "".join(draw.choice("abcé ") for _ in range(n))
    passages = [word(n) for n in (12, 20, 31, 60)]
    texts = ["".join(draw.choice([*passages, word(5), word(17)]) for _ in range(draw.randrange(1, 6))) for _ in range(40)]
    texts += [None, "", "short", "ab" * 60, "a" * 40, passages[3], passages[3], word(300)]
    got = repeats.remove_repeats(frame(spark, list(enumerate(texts))), 16, 5, large_group, texts=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(brute_repeats(texts, 16)))
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)


# --- near duplicates -----------------------------------------------------------------


def brute_components(texts, size, percent):
    sets = [setsketch.full_set((t or "").encode(), size) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "block"), [(2, 256), (5, 256), (2, 2)])
def test_near_dedup_equals_all_pairs(spark, monkeypatch, size, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    draw = random.Random(size * 7 + block)
    texts = []
    for _ in range(12):
        words = [draw.choice("the of and a to in is it be".split()) + str(draw.randrange(30)) for _ in range(draw.randrange(3, 120))]
        texts.append(" ".join(words))
        for _ in range(draw.randrange(0, 9)):  # chains of edits, some just around the bound
            words = list(words)
            for _ in range(max(1, len(words) * draw.randrange(1, 8) // 100)):
                words[draw.randrange(len(words))] = f"new{draw.random()}"
            texts.append("  ".join(words).upper() if draw.random() < 0.3 else " ".join(words))
    texts += [None, "", " \n\t", "one", "ONE", "one two", "one  two", "one two"]
    got = setsketch.near_dedup(frame(spark, list(enumerate(texts))), size, 80).collect()
    want = brute_components(texts, size, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


@pytest.mark.parametrize("n", [2048, 8192, 32768])
def test_members_of_a_large_bucket_are_not_copied_for_each_other_block(spark, n):
    """One member apart from a component of all others, at the production size of blocks."""
    sketches = spark.range(n).selectExpr("id as _key", "100L as n_shingles", "cast('x' as binary) as sketch")
    members = spark.range(n).selectExpr("7L as h", "id as _key", "if(id = 0, 0L, 1L) as label")
    rows = setsketch._in_blocks(members, sketches)
    assert n <= rows.count() <= n + n // 1000 + 2
    # every pair across components meets in one group
    groups = rows.groupBy("p", "q").agg({"label": "min", "_key": "count"}).collect()
    assert sum(g["count(_key)"] - 1 for g in groups if g["min(label)"] == 0 and g.p != g.q) == n - 1


def test_pairs_of_all_components_meet_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    draw = random.Random(4)
    label = {i: draw.choice([0, 0, 0, 1, 1, 2, 3, 4, 5]) for i in range(90)}
    sketches = spark.range(90).selectExpr("id as _key", "100L as n_shingles", "cast('x' as binary) as sketch")
    members = spark.createDataFrame([(7, i, x) for i, x in label.items()], "h bigint, _key bigint, label bigint")
    met = Counter()
    groups = {}
    for r in setsketch._in_blocks(members, sketches).collect():
        groups.setdefault((r.p, r.q), []).append((r._key, r.own))
    for (p, q), held in groups.items():
        for a, own_a in held:
            for b, own_b in held:
                if (own_a, own_b) == (p, q) and label[a] != label[b] and (p != q or a < b):
                    met[min(a, b), max(a, b)] += 1
    assert met == Counter((i, j) for i in range(90) for j in range(i + 1, 90) if label[i] != label[j])


def test_equal_short_hashes_drop_no_link():
    # ten and eight shingles, eight shared: 80%; two of the shared ones have one 32-bit hash
    sets = [np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 9], np.uint32), np.array([1, 1, 2, 3, 4, 5, 6, 7], np.uint32)]
    group = pa.table({"_key": [5, 3], "label": [5, 3], "own": [0, 0], "p": [0, 0], "q": [0, 0],
                      "n_shingles": [10, 8], "hashes": [x.tobytes() for x in sets], "apart": pa.array([None, None], pa.list_(pa.int64()))})
    assert (3, 5) in set(zip(*(x.tolist() for x in setsketch._matches(group, 80)), strict=True))


def variants(n, apart=()):
    """A group of n sets that are all linked with each other, each a component of its own."""
    sets = [np.append(np.arange(100, dtype=np.uint32), np.uint32(1000 + i)) for i in range(n)]
    others = [[b for a, b in apart if a == i] or None for i in range(n)]
    return pa.table({
        "_key": range(n), "label": range(n), "own": [0] * n, "p": [0] * n, "q": [0] * n, "n_shingles": [101] * n,
        "hashes": [x.tobytes() for x in sets], "apart": pa.array(others, pa.list_(pa.int64())),
    })


@pytest.mark.parametrize("n", [200, 400, 800])
def test_a_group_gives_a_spanning_forest(n):
    a, b = setsketch._matches(variants(n), 80)
    assert len(a) == n - 1 and (a < b).all()
    forest = setsketch.Forest(np.arange(n))
    assert all(forest.join(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_rejected_pairs_are_replaced_by_others():
    apart = [(0, j) for j in range(2, 12)]
    a, b = setsketch._matches(variants(12, apart), 80)
    assert len(a) == 11 and not set(zip(a.tolist(), b.tolist(), strict=True)) & set(apart)
    alone = setsketch._matches(variants(3, [(0, 1), (0, 2), (1, 2)]), 80)
    assert len(alone[0]) == 0


def test_links_rejected_on_the_full_sets_start_another_round(spark, monkeypatch):
    """Filters that let everything pass: only the full sets decide, round after round."""
    monkeypatch.setattr(setsketch, "_matches", lambda group, percent, own=setsketch._matches: own(group, 1))
    draw = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(14):
        words = list(base)
        for _ in range(draw.randrange(1, 7)):
            words[draw.randrange(len(words))] = f"new{draw.random()}"
        texts.append(" ".join(words))
    got = setsketch.near_dedup(frame(spark, list(enumerate(texts))), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(texts, 2, 80)


def test_near_dedup_of_repeated_rows_and_missing_ids(spark, rows):
    docs = frame(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (3, "x y"), (None, None), (None, None)])
    got = rows(setsketch.near_dedup(docs, 2), "doc_id", "n_shingles", "component_id", "kept")
    assert Counter(got) == Counter([(5, 2, 5, True), (5, 2, 5, False), (None, 2, 5, False), (3, 1, 3, True),
                                    (None, 0, None, True), (None, 0, None, True)])
    assert setsketch.kept_documents(docs, 2).count() == 4


def test_sketches_tell_similarities_apart_and_merge():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 3000).astype(np.uint64)
    for shared, likely in ((950, True), (900, True), (500, False), (100, False)):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[2000 : 3000 - shared]])
        s = [setsketch.registers(np.unique(x)) for x in (a, b)]
        one, n = [x[None, :] for x in s], np.array([1000.0])
        assert bool(setsketch.plausible(*one, n, n, 0.8)[0]) is likely
        assert (np.maximum(*s) == setsketch.registers(np.unique(np.concatenate([a, b])))).all()


def test_components_of_chains_stars_and_rings(spark, rows):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    labels = dict(rows(components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert labels == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}


@pytest.mark.parametrize("apply", [exact.exact_dedup, lines.line_dedup, repeats.remove_repeats, setsketch.near_dedup])
def test_empty_tables_and_rows(spark, apply):
    assert apply(frame(spark, [])).count() == 0
    assert apply(frame(spark, [(1, None), (2, ""), (None, None), (2, "")])).count() == 4
