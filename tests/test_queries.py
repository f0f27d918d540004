"""Every registered query against its SQL, and the shape of every plan."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference, oracle_rows, spark_rows
from checks.oracle import ORACLE
from checks import queries as checked
from checks.queries import QUERIES
from cohortspark.operators import crosstab, distribution
from cohortspark.plans import dashboard, datasets
from cohortspark.session import materialize
from cohortspark.sources import star_schema

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    return connect("/root/testdata/sf0.001")


def test_contract(spark):
    assert entry(spark).count() > 0
    assert set(QUERIES) == set(ORACLE)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_and_types(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    described = duck.execute(f"describe {ORACLE[name]}").fetchall()
    assert {c: TYPES[t] for c, t in df.dtypes} == {row[0]: row[1] for row in described}
    assert difference(spark_rows(spark, name, folder), oracle_rows(duck, name)) == ""


def nodes(plan):
    """Every node of a physical plan, with children, subqueries and finished stages."""
    text = plan.nodeName()
    yield plan
    if text.startswith("AdaptiveSparkPlan"):
        below = [plan.executedPlan()]
    elif text.endswith("QueryStage"):
        below = [plan.plan()]
    else:
        children = plan.children()
        below = [children.apply(i) for i in range(children.size())]
    subqueries = plan.subqueries()
    for child in below + [subqueries.apply(i) for i in range(subqueries.size())]:
        yield from nodes(child)


def final_plan(df):
    """The lines of the whole plan as it ran, one node each."""
    df.collect()
    return "\n".join(node.simpleString(1000) for node in nodes(df._jdf.queryExecution().executedPlan()))


@contextmanager
def written_plans(monkeypatch):
    """Plans of what is written on the way."""
    seen = []

    def watched(df, label):
        seen.append(df)
        return materialize(df, label)

    for module in (crosstab, datasets, dashboard, distribution, star_schema, checked):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", watched)
    yield seen


def problems(df):
    df.collect()
    found = []
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        line = node.simpleString(1000)
        found += [line for word in ("NestedLoop", "CartesianProduct", "Python", "Pandas") if word in line]
        if "Exchange SinglePartition" in line:
            # only one row per task may meet in one task: a partial aggregate or a limit
            below = str(node.children().apply(0).toString()).splitlines()[:4]
            if not any("partial_" in x or "LocalLimit" in x for x in below):
                found.append(f"{line}: {below[0]}")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_plan_pairs_everything_or_leaves_the_jvm(spark, folder, monkeypatch, name):
    with written_plans(monkeypatch) as written:
        df = QUERIES[name](spark, folder)
        for frame in [df, *written]:
            assert problems(frame) == []


def test_a_planted_pairing_below_a_subquery_is_found(spark):
    pairs = spark.range(3).join(spark.range(4).withColumnRenamed("id", "x"))
    hidden = spark.range(2).where(F.col("id") < pairs.agg(F.count(F.lit(1))).scalar())
    assert any("NestedLoop" in line or "Cartesian" in line for line in problems(hidden))


def test_cohort_plans_narrow_their_tables(spark, folder):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {key: spark.conf.get(key) for key in keys}
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    try:
        for name in ("dataset_diabetes", "dataset_hypertension"):
            plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") < 28
            # observations, addresses, persons, identifiers and orders
            assert plan.count("LeftSemi") >= 5, name
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_values_are_binned_once(spark, folder):
    plan = final_plan(QUERIES["histogram_default"](spark, folder))
    assert sum("hashpartitioning" in line and "center" not in line and "facts" in line for line in plan.splitlines()) <= 1
    assert sum(line.strip().startswith("HashAggregate") and "CEIL" in line and "partial_" in line for line in plan.splitlines()) <= 1


def test_item_ranks_are_limited_before_the_shuffle(spark, folder):
    for name in ("latest_with_ties", "dedup_keep_first", "top_items", "bottom_items"):
        assert "WindowGroupLimit" in final_plan(QUERIES[name](spark, folder)), name


def test_counts_are_read_once(spark, folder):
    for name in ("proportion_by_interval", "top_items", "chart_bar"):
        plan = final_plan(QUERIES[name](spark, folder))
        assert "ReusedExchange" in plan, name
        assert plan.count("o_orderdate#") and plan.count("FileScan parquet [o_custkey") == 1, name


def test_ids_are_matched_by_semi_joins(spark, folder):
    assert "LeftSemi" in final_plan(QUERIES["semi_join_ids"](spark, folder))


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = final_plan(QUERIES["filter_date_range"](spark, folder))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan
    assert "LessThan(o_orderdate,1999-01-01T00:00)" in plan
    counted = final_plan(QUERIES["derive_one_var"](spark, folder))
    assert "Exchange" not in counted
    scans = [line for line in counted.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "l_shipdate" not in scans[0]
