"""Registered queries against their SQL, and the pipeline's stages against brute force."""

from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference, row_counts
from cohortspark.llm import setsketch
from cohortspark.llm.common import table
from cohortspark.llm.oracle import ORACLE
from cohortspark.llm.queries import QUERIES


def test_one_query_per_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    got = row_counts(df.columns, [tuple(row) for row in df.collect()])
    result = connect(folder).execute(ORACLE[name])
    wanted = row_counts([c[0] for c in result.description], result.fetchall())
    assert difference(got, wanted) == ""


def test_mixing_stays_in_the_jvm(spark, folder):
    plan = QUERIES["op6_water_filling"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages_equal_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, docs
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == columns
        results[name] = {r.doc_id: r.text for r in kept.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert set(before) > set(results["toxicity"]) and len(results["toxicity"]) > 0.8 * len(before)
    newest = {}
    for i, text in results["toxicity"].items():
        newest[text] = max(i, newest.get(text, i))
    assert set(results["exact_dedup"]) == set(newest.values())
    sets = {i: setsketch.full_set(t.encode(), 5) for i, t in results["exact_dedup"].items()}
    label = {i: i for i in sets}
    with_word = defaultdict(list)
    for i in sorted(sets):
        linked = {j for s in sets[i] for j in with_word[s]}
        for j in linked:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
        for s in sets[i]:
            with_word[s].append(i)
    assert set(results["near_dedup"]) == {i for i in label if label[i] == i}
    items = [t for (t,) in duckdb.sql(f"select text from '{folder}/benchmark.parquet'").fetchall()]
    bare = lambda t: [w.strip(".,!|%&$*#") for w in t.lower().split() if w.strip(".,!|%&$*#")]
    runs = {tuple(w[i : i + 13]) for w in map(bare, items) for i in range(len(w) - 12)}
    held = {i for i, t in results["near_dedup"].items() if any(tuple(bare(t)[k : k + 13]) in runs for k in range(len(bare(t)) - 12))}
    assert set(results["decontamination"]) == set(results["near_dedup"]) - held
    mixed = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(mixed) == set(results["decontamination"])
    assert all(r.taken <= 3 * r.size for r in mixed.values())


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, h string, label int"


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "a b"), (None, None), (3, "x y " * 3000), (3, "x y " * 3000)]])
def test_stages_take_odd_rows(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, None, None, None, "k", None, 1) for i, t in rows], ODD)
    left = {"toxicity": 6, "exact_dedup": 3, "near_dedup": 5, "decontamination": 6, "mixing": 6}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        assert got.count() == (left[name] if rows else 0), name
        if name != "mixing":
            assert got.columns == docs.columns and {r["_key"] for r in got.collect()} <= {"k"}
