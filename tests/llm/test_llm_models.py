"""Quality, toxicity, language model, personal data, leaks and mixing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import decontaminate, elias_fano, mixing, ngram_lm, pii, quality, toxicity
from cohortspark.llm.common import Sieve, table
from cohortspark.llm.labelled import excerpt

DOCS = "doc_id bigint, text string, source string, score string, base string, context int"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(r + (None,))[:3] + ("s", "b", 1) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (None, "a b"), (3, "x " * 3000), (3, "x " * 3000), (4, "é ü 1.2.3.4")]


# --- classifiers ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("apply", "label", "modulus", "out", "least"),
    [(quality.score_quality, "quality", 5, 0, 0.97), (toxicity.score_toxicity, "toxic", 4, 2, 0.95)],
)
def test_held_out_accuracy(spark, apply, label, modulus, out, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in apply(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == out) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    right = np.mean([got[i].predicted == truth[i] for i in held])
    assert len(held) > 50 and right >= least


@pytest.mark.parametrize("apply", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_on_odd_rows_and_without_labels(spark, apply):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = apply(frame(spark, ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None), (None, 1, 0), (3, 1, 0), (9, 0, 0)], none.schema)
    got = apply(frame(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert apply(frame(spark, []), labels).count() == 0


def test_excerpts_span_the_whole_text():
    text = bytes(range(256)) * 40
    parts = excerpt(text, 4, 100).split(b"\n" + b"\n")
    assert excerpt(b"abc", 4, 100) == b"abc" and len(excerpt(text, 4, 100)) == 403
    assert excerpt(text, 4, 100).startswith(text[:100]) and excerpt(text, 4, 100).endswith(text[-100:]) and parts


def test_chunks_cover_the_document_and_gradients_are_right():
    draw = np.random.default_rng(0)
    texts = [bytes(draw.integers(97, 103, n, dtype=np.uint8)) for n in (3, 700, 256, 1500)]
    labels = np.array([0.0, 1, 1, 0])
    net = quality.train(texts, labels, epochs=1, steps=1)
    data, halves = net.layout(texts)
    assert halves.sum() * quality.HALF == len(data) and all(h * quality.HALF >= len(t) for h, t in zip(halves, texts, strict=True))

    def loss():
        net.prepare()
        p = np.clip(net.score(texts), 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality._gradients(net, texts, labels)
    for name, at in (("taps", (2, 98, 3)), ("taps", (0, 100, 7)), ("bias", (2,)), ("head", (5,)), ("head", (16,))):
        value = getattr(net, name)
        value[at] += 1e-3
        up = loss()
        value[at] -= 2e-3
        down = loss()
        value[at] += 1e-3
        decay = {"taps": 1e-5, "head": 1e-4}.get(name, 0) * value[at]
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at] - decay, abs=2e-3)


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(4)
    emission, trans = draw.normal(0, 2, (3, 5)), draw.normal(0, 1, (2, 2))
    length = np.array([5, 3, 1])
    p, pairs = toxicity.marginals(emission, length, trans)
    expected = np.zeros((2, 2))
    for row, n in enumerate(length):
        weights, states = [], [[(i >> t) & 1 for t in range(n)] for i in range(1 << n)]
        for y in states:
            weights.append(math.exp(sum(emission[row, t] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1))))
        total = sum(weights)
        for t in range(n):
            assert p[row, t] == pytest.approx(sum(w for w, y in zip(weights, states, strict=True) if y[t]) / total)
        for w, y in zip(weights, states, strict=True):
            for t in range(n - 1):
                expected[y[t], y[t + 1]] += w / total
    assert pairs == pytest.approx(expected)


def test_rows_of_a_text_are_one_chain():
    draw = np.random.default_rng(11)
    counts = np.array([200, 0, 64, 1, 129, 65, 0])
    row, column, begins = toxicity.chains(counts)
    emission, trans = draw.normal(0, 3, counts.sum()), draw.normal(0, 2, (2, 2))
    table = np.zeros((len(begins), toxicity.CHAIN))
    table[row, column] = emission
    p, pairs = toxicity.marginals(table, np.bincount(row), trans, begins, rows=2)
    # the same texts, each in one row that is as long as the longest
    some = counts[counts > 0]
    whole = np.zeros((len(some), some.max()))
    whole[np.arange(some.max())[None, :] < some[:, None]] = emission
    q, expected = toxicity.marginals(whole, some, trans)
    assert p[row, column] == pytest.approx(q[np.arange(some.max())[None, :] < some[:, None]], abs=1e-12)
    assert pairs == pytest.approx(expected) and pairs.sum() == pytest.approx((some - 1).sum())


def test_toxic_spans_do_not_depend_on_the_place_in_the_text():
    tagger = toxicity.SpanTagger(np.zeros(toxicity.BUCKETS), -2.0, np.array([[0.5, -0.5], [-0.5, 1.0]]), np.zeros(5))
    tagger.weights[toxicity.word_features(b"idiot")[0]] = 4
    phrase = b"idiot idiot idiot"
    for before in range(100, 170):  # the phrase lies across a border of rows at some of these places
        text = b"w " * before + phrase + b" w" * 100
        p, counts = tagger.tagged([text])
        if before == 100:
            first = p[before - 20 : before + 23]
        assert p[before - 20 : before + 23] == pytest.approx(first, abs=1e-6)


def test_toxic_spans_are_code_points():
    texts = [b"you idiot moron there", "é idiot!".encode(), b"fine words here"]
    tagger = toxicity.SpanTagger(np.zeros(toxicity.BUCKETS), -5.0, np.zeros((2, 2)), np.zeros(5))
    for word in (b"idiot", b"moron"):
        tagger.weights[toxicity.word_features(word)[0]] = 20
    assert tagger.spans(texts, *tagger.tagged(texts)) == ["4:15", "2:8", ""]


# --- language model ------------------------------------------------------------------


def test_elias_fano_round_trip_and_trie():
    draw = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (1, 2**62), (500, 40), (2000, 2**40), (300, 300)):
        values = np.sort(draw.integers(0, top, n)).astype(np.int64)
        data = elias_fano.encode(values) + b"rest"
        back, at = elias_fano.decode(data)
        assert back.tolist() == values.tolist() and data[at:] == b"rest"
    pairs = sorted({(int(a), int(b)) for a, b in zip(draw.integers(0, 60, 900), draw.integers(0, 500, 900), strict=True)})
    context, word = (np.array(x) for x in zip(*pairs, strict=True))
    level = elias_fano.TrieLevel.build(context, word, 500)
    assert [x.tolist() for x in elias_fano.TrieLevel.read(level, 500)[:2]] == [context.tolist(), word.tolist()]
    codes = (1 + np.arange(len(pairs)) % 250).astype(np.uint8)
    trie = elias_fano.MappedLevel(level, codes.tobytes(), 500)
    assert trie.find(context, word).tolist() == codes.tolist()
    missing = [(a, b) for a in range(0, 70, 7) for b in range(0, 500, 11) if (a, b) not in set(pairs)]
    assert not trie.find(*(np.array(x) for x in zip(*missing, strict=True))).any()
    trie.close()
    assert abs(np.log(ngram_lm.restored(ngram_lm.quantised(np.array([1, 7, 1000]))) / [1, 7, 1000])).max() < 0.03


@pytest.mark.parametrize(("pack_bytes", "shard_tokens"), [(8 << 20, 2_500_000), (300, 40)])
def test_language_model_equals_brute_force(spark, pack_bytes, shard_tokens):
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(draw.choice(["the", "The", "of", "é", "a1", "b", f"w{i % 7}", "x y"], draw.integers(0, 40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "the of zzz"), (62, "only held " + "the " * 500), (62, "twice")]
    got = ngram_lm.score_documents(frame(spark, rows), pack_bytes=pack_bytes, shard_tokens=shard_tokens).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    learn = [t for (i, _), t in zip(rows, tokens, strict=True) if i is not None and not held(i)]
    one = Counter(w for t in learn for w in t)
    two = Counter(p for t in learn for p in zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    base = lambda w: (one[w] + 1) / (n + v + 1)
    chance = lambda c, w: (two[c, w] + ngram_lm.PRIOR * base(w)) / (one[c] + ngram_lm.PRIOR)
    want = [
        (i, held(i), len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t),
         sum(math.log10(chance(c, w)) for c, w in zip([None, *t], t, strict=False)))
        for (i, _), t in zip(rows, tokens, strict=True)
    ]
    order = lambda r: (r[0] is None, r[0], r[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-12)
        assert a[6] == pytest.approx(b[6], abs=0.02 * b[2])
    assert ngram_lm.score_documents(frame(spark, [])).count() == 0


def test_counts_above_the_reach_of_the_least_step_are_not_clamped(spark, monkeypatch):
    counts = np.array([1, 50, 3_000_000, 25_000_000, 10**12])
    step = ngram_lm.step_for(10**12)
    assert abs(np.log(ngram_lm.restored(ngram_lm.quantised(counts, step), step) / counts)).max() < 0.06
    assert ngram_lm.step_for(2_600_000) == ngram_lm.STEP
    monkeypatch.setattr(ngram_lm, "STEP", 1.01)  # one byte reaches 12
    rows = [(i, "the " * 300) for i in range(4)]
    for r in ngram_lm.score_documents(frame(spark, rows)).collect():
        learned = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(4))
        one, ends = 300 * learned, learned
        base = lambda n: (n + 1) / (one + ends + 3)
        parts = [(ends, ends, one), *[(299 * learned, one, one)] * 299, (ends, one, ends)]
        want = sum(math.log10((k + ngram_lm.PRIOR * base(n)) / (c + ngram_lm.PRIOR)) for k, c, n in parts)
        assert r.score == pytest.approx(want, abs=0.01 * r.n_tokens)


# --- personal data -------------------------------------------------------------------

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def brute_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_patterns(spark):
    draw = np.random.default_rng(8)
    rows = [(i, "".join(draw.choice(list("a.@1+ -4(é\n"), draw.integers(0, 60)))) for i in range(150)]
    rows += [(900, "mail é.x@y.com, 4111 1111 1111 1111 and +1 (017) 555-7713; 1.2.3.4.5 0001.02.3.255 256.1.1.1"),
             (901, "a@b.c@d.ef g@h x@@y.z"), (902, None), (None, "a@b.cd"), (903, "9" * 5000 + "a" * 5000 + "@")]
    got = pii.find_pii(frame(spark, rows)).collect()
    want = {i: brute_spans(t or "") for i, t in rows}
    for r in got:
        spans = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k, _ in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}
    assert len(got) == len(rows)


def test_contexts_of_known_identifiers_find_others(spark, rows):
    seeds = [(i, f"Please call me at: +1 555 010 {1000 + i} today or later") for i in range(8)]
    new = [(20, "you may CALL ME at 555-0199-77 today"), (21, "his number 555-0199-77 is known"),
           (22, "look at page 123456 please"), (23, "call me at noon, or at 12345678")]
    prose = [(100 + i, f"look at page {100000 + i} of it") for i in range(20)]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, seeds + new + prose)).collect()}
    assert got[20].spans == "phone:19:30" and got[21].spans == "phone:11:22"  # by its context, by its value
    assert got[22].spans == got[23].spans == got[105].spans == "" and got[20].n_phone == 0
    assert all(got[i].spans.count("phone") == 1 for i in range(8))
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_contexts_reach_over_long_words_and_white_space():
    want = pii.context("mail now: x", 10)
    assert want is not None and pii.context("mail " + "now: x", 10) == want
    assert pii.context("mail " + " " * 5000 + "now:" + "\n" * 900 + "x", 5 + 5000 + 4 + 900) == want
    assert pii.context("a " * 300 + "mail now: x", 610) == want
    for n in (380, 399, 400, 450, 900, 20000):
        long = "w" * n
        assert pii.context(f"{long} mail x", n + 6) == pii.pair_hash(pii.bare_hash(long.encode()), pii.bare_hash(b"mail"))
        assert pii.context(f"mail {long} x", n + 6) == pii.pair_hash(pii.bare_hash(b"mail"), pii.bare_hash(long.encode()))
        assert pii.context(f"{long} x", n + 1) is None
        assert pii.context("(" * n + "x", n) is None and pii.context(f"mail now: {'(' * n}x", 10 + n) == want
        assert pii.context(f"mail now {long}x", 9 + n) is None


def test_chains_of_contexts_are_followed_to_their_end(spark):
    steps = 11
    value = lambda i, j: f"+1 555 010 {1000 + j}" if i == 0 else f"id-{i:02d}{j}-xyz"
    rows = [(100 * i + 10 * own + j, f"then {chr(97 + i) * 3} {chr(97 + i) * 4}: {value(i + own, j)} end")
            for i in range(steps) for own in (0, 1) for j in range(4)]
    got = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, rows)).collect()}
    assert [i for i, s in sorted(got.items()) if not s.startswith("phone:")] == []


# --- leaks ---------------------------------------------------------------------------

ITEM = "A train leaves the station at 9 am with 120 passengers and travels 60 km before Anna leaves it near the old mill."


def leaks(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs), benchmark).collect()}


def test_leaks_are_found_also_with_other_values(spark):
    other = ITEM.replace("120", "75").replace("60 km", "88 miles").replace("Anna", "Peter")
    twisted = "Take 5 apples or 5 pears, then 5 plums, and put all 5 of them in a bag with 5 more nuts for the way."
    mixed = re.sub("5", lambda _, n=iter("12345"): next(n), twisted)
    docs = [(1, "Before. " + ITEM.upper().replace(" ", "  ") + " After."), (2, f"Intro words.\n{other}\nThe end."),
            (3, ITEM[:40]), (4, mixed), (5, twisted.replace("5", "7")), (6, None), (7, ""), (8, "nothing of it " * 30),
            (9, " | ".join(ITEM.split())), (9, ITEM)]
    got = leaks(spark, docs, [(10, ITEM), (11, twisted), (12, "too short"), (13, None), (None, "")])
    assert set(got) == {(1, 10), (2, 10), (5, 11), (9, 10)}
    assert got[2, 10].same_values is False and got[9, 10].same_values is True
    assert leaks(spark, docs, []) == {} and leaks(spark, [], [(10, ITEM)]) == {}


def test_short_items_count_as_a_whole_and_long_ones_in_part(spark):
    words = [f"w{i}x" for i in range(40)]
    short = "five little words are enough"
    docs = [(1, "so " + short + " here"), (2, "five little words are not"), (3, " ".join(words[10:23])), (4, " ".join(words[10:22]))]
    got = leaks(spark, docs, [(1, short), (2, " ".join(words))])
    assert set(got) == {(1, 1), (3, 2)} and got[3, 2].matched_windows == 6


def test_items_full_of_numbers_are_found_with_other_numbers(spark):
    train = "A train goes 120 km in 3 h and 45 km in 2 h so how many km does it go in 7 h"
    digits = "Compute 12 + 35 * 4 - 6 / 2 + 9 * 17 - 8 + 21 / 3 + 5 - 11"
    other = re.sub("[0-9]+", lambda m: str(int(m.group()) + 100), digits)
    docs = [(1, re.sub("[0-9]+", lambda m: str(int(m.group()) + 1), train)), (2, "Before. " + other),
            (3, " ".join(str(i) for i in range(100, 109))), (4, "9 9 9 apples"), (5, digits)]
    got = leaks(spark, docs, [(1, train), (2, digits)])
    assert set(got) == {(1, 1), (2, 2), (5, 2)}
    assert got[1, 1].matched_windows == got[1, 1].item_windows and got[1, 1].same_values is False
    assert got[5, 2].share == 1 and got[5, 2].same_values is True and got[2, 2].same_values is False


def test_names_at_sentence_starts_and_other_case_are_found(spark):
    names = "Alice has 3 apples. Bob buys 5 pears. Carol eats 2 plums. Who of them is still hungry?"
    renamed = names.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Fay").replace("5", "8")
    short = "we went from France to old Spain by slow train"
    wrapped = "I heard that " + ITEM.replace("before Anna", "before\nPeter").replace("A train", "a train")
    docs = [(1, renamed), (2, short.lower()), (3, "SO " + short.upper()), (4, short.replace(" ", "\n")), (5, wrapped),
            (6, names.lower().replace("3", "4")), (7, renamed.replace("Who of", "who of all")), (8, "5"), (9, "minutes " + short)]
    got = leaks(spark, docs, [(1, names), (2, short), (3, ITEM)])
    assert {(1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 1), (9, 2)} <= set(got) <= {(1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 1), (9, 2), (7, 1)}
    assert all(got[i, 2].same_values for i in (2, 3, 4, 9)) and not got[1, 1].same_values and not got[6, 1].same_values


def test_items_under_the_shortest_match_whole_texts_only(spark):
    docs = [(1, "Too SHORT."), (2, "too short indeed"), (3, "42"), (4, "17"), (5, ""), (6, None), (7, "| too\nshort |"), (8, "too"), (9, "five words of an item")]
    items = [(1, "too short"), (2, "17"), (3, ""), (4, "five words of an item")]
    assert set(leaks(spark, docs, items)) == {(1, 1), (7, 1), (4, 2), (9, 4)}
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(frame(spark, docs), benchmark, shortest=2).collect()
    assert {(1, 1), (2, 1), (7, 1), (9, 4)} <= {(r.doc_id, r.item_id) for r in found}


def test_windows_that_many_items_and_documents_share_are_not_joined(spark, monkeypatch):
    counted = {}

    def counting(df, label):
        counted[label] = (out := write(df, label)).count()
        return out

    write = decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", counting)
    shared = "answer this question with one of the choices given below now"
    own = lambda kind, i: " ".join(f"{kind}{i}x{j}q" for j in range(20))
    items = [(i, f"{shared} {own('item', i)}") for i in range(200)]
    docs = [(i, f"{shared} {own('doc', i)}") for i in range(200)] + [(900, "see " + items[7][1])]
    assert set(leaks(spark, docs, items)) == {(900, 7)}
    assert counted["candidates"] < 1000 and counted["found-windows"] < 1000


def brute_leaks(docs, items):
    """All windows of all documents against all windows of all items, by words instead of hashes."""
    ways = [(1, 1), (2, 2), (2, 3), (3, 2), (3, 3)]
    out = {}

    def rows(text, size):
        t = decontaminate.Templates([text.encode()])
        words = [t.words[c] for c in t.codes]
        template = lambda k, i: tuple(w if k[x] == 0 else int(k[x]) for x, w in enumerate(words[i : i + size], i))
        return [[(template(k, i), tuple(t.slots(k, i, size))) for k in t.kinds] for i in range(len(words) - size + 1)]

    for doc_id, doc in docs:
        for item_id, item in items:
            n = len(decontaminate.Templates([item.encode()]).codes)
            size = min(8, n)
            lines = {}
            for i, a in enumerate(rows(item, size) if n >= 5 else []):
                for j, b in enumerate(rows(doc, size)):
                    met = {(x, y) for x in range(4) for y in range(4) if a[x][0] == b[y][0]}
                    if met:
                        lines.setdefault(j - i, []).append((i, a, b, met))
            at, doc_at, doc_same = set(), set(), set()
            for line, matches in lines.items():
                consistent = lambda pairs: len(pairs) == len({x for x, _ in pairs})
                values = lambda way: {p for _, a, b, met in matches if way in met for p in zip(a[way[0]][1], b[way[1]][1], strict=True)}  # noqa: E731, B023
                numbers = {p for _, a, b, met in matches for x, y in met for p in zip(a[x][1], b[y][1], strict=True) if not p[0].startswith("name=")}
                same = {i for i, a, b, met in matches if any(a[x][1] == b[y][1] for x, y in met)}
                good = set(same)
                if consistent(numbers) and consistent(values((2, 2))):
                    good |= {i for w in ways if consistent(values(w)) for i, _, _, met in matches if w in met}
                at |= good
                doc_at |= {i + line for i in good}
                doc_same |= {i + line for i in same}
            matched = min(len(at), len(doc_at))
            if n and matched >= min(n - size + 1, max(1, 13 - size + 1)):
                out[doc_id, item_id] = (matched, n - size + 1, len(doc_at) == len(doc_same))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_comparing_all_windows(spark, seed):
    draw = random.Random(seed)
    pool = ["the", "of", "and", "goes", "to", "Anna", "Bob", "Paris", "3", "5", "120", "km", "7kg", "apples.", "with", "who"]
    text = lambda n: " ".join(draw.choice(pool) for _ in range(n))
    items = [(i, text(draw.choice([5, 7, 8, 10, 13, 16, 24]))) for i in range(12)] + [(90, "3 5 120 3 5 120 3 5 7"), (91, "")]
    docs = [(i, text(60)) for i in range(4)]
    for i, (_, item) in enumerate(items):
        words = [draw.choice(["9", "44"]) if w.isdigit() and draw.random() < 0.4 else w for w in item.split()]
        words = [draw.choice(["Carl", "Dora"]) if w in ("Anna", "Bob") and draw.random() < 0.3 else w for w in words]
        docs.append((10 + i, f"{text(5)} {' '.join(words)} {text(4)}"))
        docs.append((40 + i, f"{text(3)} {' '.join(words[draw.randrange(1 + len(words) // 3):])}"))
    got = {key: (r.matched_windows, r.item_windows, r.same_values) for key, r in leaks(spark, docs, items).items()}
    assert got == brute_leaks(docs, items) and got


def test_a_unit_after_another_text_is_a_word():
    alone, behind = decontaminate.Templates([b"km of road"]), decontaminate.Templates([b"it is 5", b"km of road"])
    assert [k[3:].tolist() for k in behind.kinds] == [k.tolist() for k in alone.kinds]


def test_leaking_documents_go_with_their_columns(spark, rows):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    docs = frame(spark, [(1, ITEM), (2, "clean"), (2, "clean"), (None, ITEM), (None, "fine")])
    kept = decontaminate.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["clean", "clean", "fine"]


# --- mixing --------------------------------------------------------------------------


def brute_targets(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = {s: w for s, w in weights.items() if s not in clamped}
        rest = total - sum(3 * sizes[s] for s in clamped)
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in clamped}
        clamped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_clamping(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {f"s{i:02d}": int(draw.lognormal(4, 2)) for i in range(draw.integers(1, 14))} | {None: 5, "é": 0}
    source = spark.createDataFrame([(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(source).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_rows_without_ids_come_near_their_target(spark):
    docs = frame(spark, [(None, "one two three", "a")] * 6000 + [(None, "one", None)] * 3000 + [(5, "x y", "b")])
    mixed = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    assert {r.source: r["count(1)"] for r in mixed} == {"a": 6000, "b": 1, None: 3000}
    for r in mixed:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 3


def test_mix_comes_near_its_targets_and_repeats(spark, rows):
    draw = np.random.default_rng(9)
    data = [(i, "w " * int(draw.integers(0, 60)), draw.choice(["a", "b", "c", "d"])) for i in range(2000)]
    data += [(None, "one two", None), (None, "one two", None), (7, None, "a"), (8, " \n", "b")]
    docs = frame(spark, [(i, t, None if s is None else str(s)) for i, t, s in data])
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(data) and all(0 <= r.taken <= 3 * r.size for r in mixed)
    for source in ("a", "b", "c", "d"):
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 * math.sqrt(len(own))
    assert rows(mixing.mix(docs)) == sorted(map(tuple, mixed), key=repr)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_sieve_never_rejects_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    sieve = Sieve(spark.createDataFrame([(int(k),) for k in keys], "k bigint"), "k", bits=1 << 20)
    assert sieve.may_hold(keys).all()
    assert sieve.may_hold(keys + 1).mean() < 0.05
