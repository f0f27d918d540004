"""Operators against hand-computed answers and brute force."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime

from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import counts, crosstab, distribution, filters, joins, latest, pages, places, reshape
from cohortspark.session import materialize
from cohortspark.operators.derive import Category, ColumnDefinition, derive_column, stack


def at(text):
    return datetime.fromisoformat(text)


# --- filters -------------------------------------------------------------------------


def test_voided_as_number_or_boolean(spark, rows):
    for kind, data in (("int", [(1, 0), (2, 1), (3, None)]), ("boolean", [(1, False), (2, True), (3, None)])):
        df = spark.createDataFrame(data, f"id int, voided {kind}")
        assert rows(filters.active(df), "id") == [(1,)]


def test_end_date_is_included(spark, rows):
    df = spark.createDataFrame(
        [(at("2017-01-31 23:59:59"),), (at("2017-02-01"),), (at("2016-12-31"),), (None,)],
        "ts timestamp_ntz",
    )
    kept = filters.in_range(df, "ts", date(2017, 1, 1), date(2017, 1, 31))
    assert rows(kept) == [(at("2017-01-31 23:59:59"),)]
    assert filters.in_range_unless_all(df, "ts", None, None, True).count() == 4
    with pytest.raises(ValueError, match="start"):
        filters.in_range_unless_all(df, "ts", None, None, False)


CONCEPTS = "concept_id bigint, name string, concept_name_type string, voided int"


def test_concept_lookup(spark):
    concepts = spark.createDataFrame(
        [(1, "A", "FULLY_SPECIFIED", 0), (2, "A", "SHORT", 0), (3, "B", "FULLY_SPECIFIED", 0),
         (4, "B", "FULLY_SPECIFIED", 0)], CONCEPTS,
    )
    obs = spark.createDataFrame([(1,), (2,), (3,)], "concept_id bigint")
    for lookup in (filters.lookup_concept, filters.single_concept):
        assert obs.where(obs.concept_id == lookup(concepts, "A")).count() == 1
        assert obs.where(obs.concept_id == lookup(concepts, "none")).count() == 0
        with pytest.raises(Exception, match="(?i)several concepts|more than one row"):
            obs.where(obs.concept_id == lookup(concepts, "B")).count()


def test_where_concept(spark, rows):
    concepts = spark.createDataFrame([(1,), (3,), (3,)], "concept_id bigint")
    obs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "id int, value_coded bigint")
    assert rows(joins.where_concept(obs, "value_coded", concepts), "id") == [(1,), (3,)]
    assert joins.where_concept(obs, "value_coded", concepts.where("false")).count() == 0


def test_any_not_null_with_odd_names(spark, rows):
    df = spark.createDataFrame([(1, None), (None, "x"), (None, None)], "`a b` int, `c.d` string")
    assert rows(filters.any_not_null(df, ["a b", "c.d"])) == [(1, None), (None, "x")]


def test_numeric_columns_and_summary(spark, rows):
    df = spark.createDataFrame([(1, 2.5, "x"), (3, None, "y")], "`a b` int, c double, d string")
    assert filters.numeric_columns(df) == ["a b", "c"]
    assert rows(filters.numeric_summary(df)) == [("a b", 2, 1.0, 3.0), ("c", 1, 2.5, 2.5)]


def test_table_view_pages_cover_the_table_once(spark):
    df = spark.range(95).selectExpr("id % 7 as a", "cast(id as string) as b")
    pages = [filters.table_view(df, order_by=[("a", False)], page=p, size=10) for p in range(1, 11)]
    seen = [tuple(row) for page in pages for row in page.collect()]
    assert len(seen) == 95
    assert set(seen) == {tuple(row) for row in df.collect()}
    assert [row[0] for row in seen] == sorted((row[0] for row in seen), reverse=True)
    found = filters.table_view(df, {"b": "9", "a": (2, None)}, page=1, size=100)
    assert {row.b for row in found.collect()} == {
        str(i) for i in range(95) if "9" in str(i) and i % 7 >= 2
    }


# --- joins ---------------------------------------------------------------------------


def test_null_matches_null_in_the_null_safe_join(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20), (None, 21)], "rk string, v int")
    expected = [(1, 10), (2, 20), (2, 21), (3, None)]
    assert rows(joins.left_null_safe(left, right, "k", "rk"), "id", "v") == expected
    without = left.where("k is not null")
    assert rows(joins.left_null_safe(without, right, "k", "rk"), "id", "v") == [(1, 10), (3, None)]


def test_null_matches_nothing_in_the_plain_left_join(spark, rows):
    left = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id int, k bigint")
    right = spark.createDataFrame([(7, 10), (7, 11), (None, 20)], "rk bigint, v int")
    joined = joins.left_on(left, right, "k", "rk")
    assert joined.columns == ["id", "k", "rk", "v"]
    assert rows(joined, "id", "v") == [(1, 10), (1, 11), (2, None), (3, None)]


@contextmanager
def settings(spark, **wanted):
    conf = {key.replace("__", "."): value for key, value in wanted.items()}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


PLAIN = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__enabled": "false"}


def per_task(df):
    return [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("join", [joins.left_on, joins.left_null_safe])
def test_rows_without_a_key_are_spread_over_the_tasks(spark, join):
    made = spark.range(20000).selectExpr("id", "case when id % 10 = 0 then id % 1000 end as k")
    left = materialize(made, "left")
    right = materialize(spark.range(1000).selectExpr("id as rk", "id as v"), "right")
    with settings(spark, spark__sql__shuffle__partitions="8", **PLAIN):
        joined = join(left, right, "k", "rk")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan.replace("coalesce(", "") and "left_" in plan.split("Exchange hashpartitioning")[1]
        counts = per_task(joined)
        assert max(counts) <= 2 * sum(counts) / 8
        assert joined.where("v is not null").count() == 2000 and sum(counts) == 20000


def test_ties_of_a_hot_group_are_spread_over_the_tasks(spark):
    made = spark.range(100000).selectExpr(
        "id", "if(id % 2 = 0, 0, id) as g", "if(id % 2 = 0, date'2020-01-01', date_add(date'2020-01-01', cast(id % 7 as int))) as ts"
    )
    made = materialize(made, "ties")
    with settings(spark, spark__sql__shuffle__partitions="8", **PLAIN):
        newest = latest.latest(made, ["g"], "ts")
        counts = per_task(newest)
        assert sum(counts) == 100000 and max(counts) <= 2 * sum(counts) / 8


def test_latest_keeps_ties_and_leaves_undated_groups_out(spark, rows):
    draw = random.Random(7)
    data = [(i, draw.choice(["a", "b", None, "u"]), draw.randrange(4)) for i in range(200)]
    df = spark.createDataFrame([(i, g, None if g == "u" and i % 5 == 0 else t) for i, g, t in data], "id int, g string, ts int")
    greatest = {g: max(t for _, h, t in data if h == g) for g in ("a", "b", None)}
    got = rows(latest.latest(df, ["g"], "ts"))
    assert got == sorted(((i, g, t) for i, g, t in data if greatest.get(g) == t), key=repr) and got


def test_many_rows_without_a_key_on_both_sides(spark):
    left = materialize(spark.range(4000).selectExpr("id", "if(id % 10 = 0, id, null) as k"), "left")
    right = materialize(spark.range(1000).selectExpr("if(id % 10 = 0, null, id) as rk", "id as v"), "right")
    with settings(spark, spark__sql__shuffle__partitions="8", **PLAIN):
        counts = per_task(joins.left_null_safe(left, right, "k", "rk"))
        assert sum(counts) == 3600 * 100 + 400 and max(counts) <= 2 * sum(counts) / 8
        few = joins.left_null_safe(left.where("id < 20"), right.where("v < 20"), "k", "rk")
        assert few.where("k is null").count() == 18 * 2


def test_semi_join_with_missing_keys_moves_no_row_without_one(spark, rows):
    lines = materialize(spark.range(100000).selectExpr("id", "if(id % 10 = 0, cast(id as string), null) as k"), "lines")
    with settings(spark, spark__sql__shuffle__partitions="8", **PLAIN):
        for own, wanted in (("uuid in ('10', '20') or uuid is null", 90002), ("uuid in ('10', '20')", 2), ("uuid is null", 90000)):
            keys = spark.createDataFrame([("10",), ("20",), (None,)], "uuid string").where(own)
            kept = joins.keep_matching_null_safe(lines, keys, "k", "uuid")
            counts = per_task(kept)
            assert sum(counts) == wanted
            if wanted > 10:
                assert max(counts) <= 2 * sum(counts) / lines.rdd.getNumPartitions()


def test_pages_by_place_and_after_a_row(spark):
    draw = random.Random(3)
    data = [(draw.choice([None, 1.5, 2.5, float("nan")]), draw.choice(["x", "y", None]), draw.randrange(9)) for _ in range(3000)]
    df = materialize(spark.createDataFrame(data, "a double, b string, place int"), "table")
    for order in ([("b", False), ("a", True)], [("a", False)], []):
        keys = pages.sort_keys(pages.total_order(df, order))
        wanted = [repr(r) for r in df.orderBy(*keys).collect()]
        sorted_once = pages.SortedPages(df, order)
        last, seen = None, []
        for page in (1, 2, 37, 300, 301):
            got = [repr(r) for r in sorted_once.page(page, 10).collect()]
            assert got == wanted[(page - 1) * 10 : page * 10]
            assert got == [repr(r) for r in filters.table_view(df, order_by=order, page=page, size=10).collect()]
        while len(seen) < 200:
            found = filters.table_view(df, order_by=order, size=20, after=last, shown=shown if last else 1).collect()
            seen += map(repr, found)
            last = found[-1].asDict()
            shown = next((k for k, r in enumerate(reversed(seen)) if r != repr(found[-1])), len(seen))
        assert seen == wanted[: len(seen)]
    with pytest.raises(ValueError, match="no place"):
        filters.table_view(df, after={"a": 1.5, "b": "x"})


def test_a_deep_page_reads_its_own_rows(spark):
    df = materialize(spark.range(90100).selectExpr("(id * 7919) % 90100 as k", "id"), "table")
    page = filters.table_view(df, order_by=[("k", True)], page=9000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GreaterThanOrEqual(place" in plan
    assert [r.k for r in page.collect()] == list(range(89990, 90000))


def test_thinned_scatter_keeps_all_counts(spark):
    made = spark.range(5000).selectExpr("id % 97 * 1.25 as x", "cast(id * 31 % 89 as int) as y", "if(id % 3 = 0, 'F', null) as Gender")
    whole = distribution.scatter(made, "x", "y")
    points = whole.count()
    assert distribution.scatter(made, "x", "y", max_points=points).count() == points
    before = 0
    for most in (2, 10, 100, 1000, points - 1):
        thinned = distribution.scatter(made, "x", "y", max_points=most)
        found = thinned.collect()
        assert sum(r.n for r in found) == 5000 and before <= len(found) <= most
        assert all(0 <= r.x <= 120 and 0 <= r.y <= 88 for r in found) and thinned.columns == whole.columns
        before = len(found)
    assert distribution.scatter(made, "x", "y", max_points=1).count() == 2  # colours are not merged
    flat = distribution.scatter(made.selectExpr("1 as x", "y", "Gender"), "x", "y", max_points=5)
    assert flat.agg(F.sum("n")).first()[0] == 5000
    assert distribution.scatter(made.where("x < 0"), "x", "y", max_points=5).count() == 0


def test_levels_are_copied_to_the_blocks_that_exist(spark):
    data = spark.range(3000).selectExpr("id as a", "if(id % 2 = 0, 'F', 'M') as b")
    dense = crosstab.crosstab(data, "a", "b", dense=True)
    assert dense.count() == 6000
    counted = data.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    blocks = crosstab._blocks(crosstab._levels(counted, "b", "level_2"))
    copies = crosstab._levels(counted, "a", "level_1").withColumn("block", crosstab._every(blocks))
    assert copies.count() == 3000


def test_duplicate_concept_names_fan_out(spark, rows):
    concepts = spark.createDataFrame(
        [(1, "A", "FULLY_SPECIFIED", 0), (1, "A2", "FULLY_SPECIFIED", 0), (1, "a", "SHORT", 0)],
        CONCEPTS,
    )
    obs = spark.createDataFrame([(9, 1), (8, 2)], "obs_id int, value_coded bigint")
    assert rows(joins.with_concept_name(obs, concepts)) == [(9, 1, "A"), (9, 1, "A2")]


def test_geocodes(spark, rows):
    counted = spark.createDataFrame([("Pune", 3), ("Delhi", 1)], "place string, total bigint")
    known = spark.createDataFrame([("Pune", 18.5, 73.8)], "address string, lat double, lon double")
    assert rows(joins.with_geocodes(counted, known)) == [("Delhi", 1, None, None), ("Pune", 3, 18.5, 73.8)]
    assert rows(joins.unresolved_places(counted, known, "India")) == [("Delhi", 1, "India Delhi")]


# --- derived columns -----------------------------------------------------------------

LEVELS = ColumnDefinition("level", "x", (Category("lo", 0, 5), Category("hi", 5, 9)))


def test_overlaps_duplicate_and_gaps_drop(spark, rows):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (12.0,), (None,)], "x double")
    assert rows(derive_column(df, LEVELS)) == [(1.0, "lo"), (5.0, "hi"), (5.0, "lo"), (9.0, "hi")]


def test_derived_column_replaces_one_of_its_name(spark, rows):
    df = spark.createDataFrame([(1.0, "old"), (5.0, "old")], "x double, level string")
    derived = derive_column(df, LEVELS)
    assert derived.columns == ["x", "level"]
    assert rows(derived) == [(1.0, "lo"), (5.0, "hi"), (5.0, "lo")]
    own = ColumnDefinition("x", "x", LEVELS.categories)
    assert rows(derive_column(df.select("x"), own)) == [("hi",), ("lo",), ("lo",)]


def test_two_variables_from_json(spark, rows):
    text = """{"risk": {"datatype": "Numeric", "usingTwoVars": true, "firstColName": "a b",
      "secondColName": "c", "categories": [
        {"Name": "low", "Range": {"From": 0, "To": 5, "FromOther": 0, "ToOther": 1}},
        {"Name": "high", "Range": {"From": 3, "To": 9, "FromOther": 1, "ToOther": 2}}]}}"""
    definition = ColumnDefinition.all_from_json(text)["risk"]
    df = spark.createDataFrame([(4, 1.0), (4, 0.5), (9, 2.0), (4, None)], "`a b` int, c double")
    assert rows(derive_column(df, definition)) == [
        (4, 0.5, "low"), (4, 1.0, "high"), (4, 1.0, "low"), (9, 2.0, "high"),
    ]


@pytest.mark.parametrize(
    "spec",
    [
        {"firstColName": "x", "categories": []},
        {"firstColName": "", "categories": [{"Name": "a", "Range": {"From": 1, "To": 2}}]},
        {"firstColName": "x", "categories": [{"Name": "", "Range": {"From": 1, "To": 2}}]},
        {"firstColName": "x", "categories": [{"Name": "a", "Range": {"From": 1, "To": "NA"}}]},
        {"firstColName": "x", "usingTwoVars": True,
         "categories": [{"Name": "a", "Range": {"From": 1, "To": 2}}]},
    ],
)
def test_incomplete_definitions(spec):
    with pytest.raises(ValueError):
        ColumnDefinition.from_spec("level", spec)


def test_only_numbers_can_be_bucketed(spark):
    df = spark.createDataFrame([("1",)], "x string")
    with pytest.raises(ValueError, match="numeric"):
        derive_column(df, LEVELS)


def test_stack_by_name(spark, rows):
    top = spark.createDataFrame([(1, "a")], "n int, s string")
    assert rows(stack([top, top.select("s", "n")])) == [(1, "a"), (1, "a")]


# --- latest and first ----------------------------------------------------------------


def test_latest_keeps_ties_and_drops_undated_groups(spark, rows):
    data = [("p", 1, at("2017-01-01")), ("p", 2, at("2017-02-01")), ("p", 3, at("2017-02-01")),
            ("q", 4, at("2017-01-01")), ("q", 5, None), (None, 6, at("2016-01-01"))]
    df = spark.createDataFrame(data, "person string, id int, ts timestamp_ntz")
    newest = latest.latest(df, ["person"], "ts")
    assert newest.columns == df.columns
    assert rows(newest, "id") == [(2,), (3,), (6,)]


def test_first_per(spark, rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 4), (None, 3)], "k string, v int")
    assert rows(latest.first_per(df, ["k"], [F.col("v")])) == [("a", 1), (None, 3)]


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2500), ("c", 1000)], "k string, n bigint")
    repeated = latest.repeat_rows(df, "n")
    assert repeated.columns == ["k"]
    assert Counter(row.k for row in repeated.collect()) == {"a": 1, "b": 2500, "c": 1000}


# --- reshaping -----------------------------------------------------------------------


def test_unpivot_prints_whole_numbers_plainly(spark, rows):
    df = spark.createDataFrame(
        [(1, 120.0, None), (2, 27.5, "x"), (3, None, None)],
        "id int, value_numeric double, value_text string",
    )
    assert rows(reshape.unpivot_values(df, ["id"])) == [
        (1, "value_numeric", "120"), (2, "value_numeric", "27.5"), (2, "value_text", "x"),
    ]


def test_pivot_types_and_missing_variables(spark, rows):
    df = spark.createDataFrame(
        [("p", "BMI", 22.5, None), ("p", "Status", None, "Normal"), ("q", "BMI", 20.0, "text"),
         ("q", "Status", 3.0, "text")],
        "id string, name string, value_numeric double, value_text string",
    )
    wide = reshape.pivot_variables(df, ["id"], {"BMI": "double", "Status": "string", "FBS": "double"})
    assert wide.columns == ["id", "BMI", "Status", "FBS"]
    assert rows(wide) == [("p", 22.5, "Normal", None), ("q", 20.0, "3", None)]


def test_retype(spark):
    df = spark.createDataFrame(
        [("TRUE", "1", "1.5", "27.5x", "3000000000", None), ("F", None, "2e3", "1", "1", None)],
        "a string, b string, c string, d string, e string, f string",
    )
    typed = reshape.retype(df, df.columns)
    assert [kind for _, kind in typed.dtypes] == ["boolean", "int", "double", "string", "double", "boolean"]
    assert typed.collect()[1] == (False, None, 2000.0, "1", 1.0, None)


# --- counts, shares, item filter -----------------------------------------------------


def visits(spark, data):
    return spark.createDataFrame(data, "`Visit Date` timestamp_ntz, Diagnosis string, Gender string")


def test_counts_keep_missing_groups_and_shares_use_the_interval(spark, rows):
    df = visits(spark, [(at("2017-01-05"), "A", "F"), (at("2017-01-09"), "A", None),
                        (at("2017-01-09"), None, "F"), (at("2017-02-01"), "A", "F"),
                        (None, "A", "F")])
    shared = counts.with_percentage(counts.interval_counts(df, ["Diagnosis", "Gender"], "Months"), "Months")
    assert rows(shared, "Diagnosis", "Gender", "Months", "total", "percentage") == sorted(
        [("A", "F", at("2017-01-01"), 1, 33.33), ("A", None, at("2017-01-01"), 1, 33.33),
         (None, "F", at("2017-01-01"), 1, 33.33), ("A", "F", at("2017-02-01"), 1, 100.0),
         ("A", "F", None, 1, 100.0)], key=repr)


def test_text_dates_are_parsed(spark, rows):
    df = spark.createDataFrame([("2017-05-09 10:00:00", "A"), ("2017-05-09", "B")], "`Visit Date` string, d string")
    assert rows(counts.interval_counts(df, ["d"], "Years")) == [("A", at("2017-01-01"), 1), ("B", None, 1)]


def totals(spark, data):
    return spark.createDataFrame(data, "i int, item string, total bigint")


@pytest.mark.parametrize(
    ("options", "kept"),
    [
        ({"n": 2}, ["A", "B"]),
        ({"n": 2, "mode": "strict"}, ["A", "C"]),
        ({"n": 1, "ascending": True}, ["A"]),
        ({"n": 1}, ["C"]),
        ({"n": 5}, ["A", "B", "C"]),
    ],
)
def test_item_filter(spark, rows, options, kept):
    df = totals(spark, [(1, "A", 5), (1, "B", 5), (1, "C", 9)])
    assert rows(counts.top_items(df, ["i"], ["item"], **options), "item") == [(k,) for k in kept]


def test_item_filter_against_brute_force(spark, rows):
    random.seed(3)
    data = [(i, f"x{k:02d}" if k else None, random.randint(1, 6)) for i in range(5) for k in range(40)]
    data += [(None, "only", 4)]
    df = totals(spark, data)
    for ascending in (False, True):
        for n in (1, 3, 7):
            expected = []
            for group in {row[0] for row in data}:
                rows_of = [row for row in data if row[0] == group]
                sign = 1 if ascending else -1
                good = [r for r in rows_of if sum(sign * o[2] < sign * r[2] for o in rows_of) < n]
                expected += sorted(good, key=lambda r: (r[1] is None, r[1] or ""))[:n]
            got = counts.top_items(df, ["i"], ["item"], n=n, ascending=ascending)
            assert rows(got) == sorted(expected, key=repr)


def test_item_filter_by_a_name_with_spaces(spark, rows):
    df = spark.createDataFrame([(1, "OPD", "A", 3), (1, "IPD", "B", 4)], "m int, `Care Setting` string, d string, total bigint")
    assert len(rows(counts.bottom_items(df, ["m", "Care Setting"], ["d", "Care Setting"], n=1))) == 2


def test_summary_lines(spark, rows):
    df = totals(spark, [(1, "A", 2), (1, "B", 4), (1, "C", 9), (2, "A", 3)])
    got = {f: dict(rows(counts.summary_line(df, "i", f))) for f in counts.SUMMARIES}
    assert got["sum"] == {1: 15.0, 2: 3.0}
    assert got["mean"] == {1: 5.0, 2: 3.0}
    assert got["median"] == {1: 4.0, 2: 3.0}
    assert got["sd"][1] == pytest.approx(np.std([2, 4, 9], ddof=1)) and got["sd"][2] is None
    with pytest.raises(ValueError, match="func"):
        counts.summary_line(df, "i", "mode")


def test_quarter_grid(spark, rows):
    df = visits(spark, [(at("2017-05-09"), "A", "F"), (at("2017-11-30"), "A", "F")])
    ticks = [at(f"2017-{m:02d}-01") for m in (1, 4, 7, 10)] + [at("2018-01-01")]
    assert rows(counts.interval_grid(df)) == sorted([(t,) for t in ticks], key=repr)


# --- cross-tabulation ----------------------------------------------------------------


def test_crosstab_has_zero_cells_and_keeps_emptied_levels(spark, rows):
    df = spark.createDataFrame([("M", "x"), ("F", "y"), (None, "y"), ("Z", None)], "a string, b string")
    assert rows(crosstab.crosstab(df, "a", "b", dense=True)) == [
        ("F", "x", 0), ("F", "y", 1), ("M", "x", 1), ("M", "y", 0), ("Z", "x", 0), ("Z", "y", 0),
    ]
    assert rows(crosstab.crosstab(df, "a", "b")) == [("F", "y", 1), ("M", "x", 1)]
    assert rows(crosstab.crosstab(df, "a")) == [("F", 1), ("M", 1), ("Z", 1)]
    assert sum(row[3] for row in rows(crosstab.crosstab(df, "a", "b", True))) == 1.0
    assert rows(crosstab.crosstab_wide(df, "a", "b")) == [("F", 0, 1), ("M", 1, 0), ("Z", 0, 0)]
    assert rows(crosstab.crosstab_wide(df, "a", "b", ["y"])) == [("F", 1), ("M", 0), ("Z", 0)]


def test_crosstab_of_many_levels_is_complete(spark):
    df = spark.range(600).selectExpr("id % 100 as a", "cast(id % 37 as string) as b")
    cells = {(row.a, row.b): row.n for row in crosstab.crosstab(df, "a", "b", dense=True).collect()}
    brute = Counter((i % 100, str(i % 37)) for i in range(600))
    assert len(cells) == 3700
    assert all(cells[key] == brute[key] for key in cells)


def test_crosstab_column_limit(spark):
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError, match="levels"):
            crosstab.crosstab_wide(spark.range(5).selectExpr("id as a", "id as b"), "a", "b")
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)


# --- distributions -------------------------------------------------------------------


def numbers(spark, values):
    unusable = [(None,), (float("nan"),), (float("inf"),)]
    return spark.createDataFrame([(float(v),) for v in values] + unusable, "x double")


@pytest.mark.parametrize(
    ("values", "bins"),
    [
        ([1, 5, 6, 15, 16], [(0.0, 2), (10.0, 2), (20.0, 1)]),
        ([5, 6, 15, 16], [(10.0, 3), (20.0, 1)]),
        ([-5, -4, 5], [(0.0, 3)]),
        ([7], [(10.0, 1)]),
    ],
)
def test_histogram_of_a_width(spark, rows, values, bins):
    assert rows(distribution.histogram(numbers(spark, values), "x", 10)) == bins


def test_default_histogram(spark, rows):
    df = numbers(spark, [0, 1, 29, 58])
    assert rows(distribution.histogram(df, "x")) == [(0.0, 2), (28.0, 1), (58.0, 1)]
    assert [n for _, n in rows(distribution.histogram(numbers(spark, [3, 3]), "x"))] == [2]
    assert rows(distribution.histogram(numbers(spark, []), "x", 10)) == []
    with pytest.raises(ValueError, match="positive"):
        distribution.histogram(df, "x", 0)


def test_stacked_histogram_moves_a_minimum_on_an_edge_in_every_stack(spark, rows):
    df = spark.createDataFrame([(5.0, "a"), (6.0, "a"), (5.0, None), (25.0, None)], "x double, f string")
    assert rows(distribution.histogram(df, "x", 10, fill="f")) == [(10.0, "a", 2), (10.0, None, 1), (20.0, None, 1)]


def test_box(spark, rows):
    df = spark.createDataFrame(
        [(at("2017-01-05"), float(v)) for v in (1, 2, 3, 10)]
        + [(at("2017-02-05"), 4.0), (at("2017-02-05"), None), (None, 5.0)]
        + [(at("2017-02-05"), float("nan")), (at("2017-02-05"), float("-inf"))],
        "`Visit Date` timestamp_ntz, y double",
    )
    boxes = distribution.box_stats(df, "y", "Months")
    assert rows(boxes) == [
        (at("2017-01-01"), 1.75, 2.5, 4.75, 1.0, 4.75), (at("2017-02-01"), 4.0, 4.0, 4.0, 4.0, 4.0),
    ]
    assert rows(distribution.box_outliers(df, "y", "Months")) == [(at("2017-01-01"), 10.0)]
    assert distribution.box_stats(df, "y", "Months", approximate=True).count() == 2


@pytest.mark.parametrize("accuracy", [10_000, 500])
def test_exact_quantiles_of_uneven_groups(spark, accuracy):
    """A third of all rows in one group, ties, heavy tails, tiny groups, a missing key."""
    draw = np.random.default_rng(5)
    groups = {
        "hot": np.round(draw.lognormal(3, 2, 9000), 2),
        "ties": np.where(draw.random(7000) < 0.6, 4.0, draw.random(7000)),
        "constant": np.full(2000, 7.5),
        "pair": np.array([1.0, 2.0]),
        "one": np.array([-3.0]),
        None: draw.normal(0, 1, 9000),
    }
    data = [(key, float(v)) for key, values in groups.items() for v in values]
    df = spark.createDataFrame(data, "g string, y double").repartition(16)
    probabilities = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = distribution.group_quantiles(df, ["g"], "y", probabilities, accuracy).collect()
    assert {row.g for row in got} == set(groups)
    for row in got:
        expected = np.quantile(groups[row.g], probabilities)
        assert [row[f"q{i}"] for i in range(5)] == pytest.approx(list(expected), rel=1e-12)


def test_scatter_merges_points(spark, rows):
    df = spark.createDataFrame(
        [(1.0, 2.0, "F"), (1.0, 2.0, "F"), (1.0, 2.0, None), (None, 2.0, "F"),
         (float("nan"), 2.0, "F")],
        "x double, y double, Gender string",
    )
    assert rows(distribution.scatter(df, "x", "y")) == [(1.0, 2.0, "F", 2), (1.0, 2.0, None, 1)]


# --- places --------------------------------------------------------------------------


def test_places(spark, rows):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",), (None,)], "State string")
    counted = places.place_counts(df, "State")
    assert rows(counted) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(places.busiest_place(counted)) == [("a", 2)]
    with pytest.raises(ValueError, match="map"):
        places.place_counts(df, "Gender")


# --- properties ----------------------------------------------------------------------


def test_shares_of_an_interval_add_up(spark, folder):
    from checks.queries import QUERIES

    shares, cells = defaultdict(float), Counter()
    for row in QUERIES["proportion_by_interval"](spark, folder).collect():
        shares[row.Months] += row.percentage
        cells[row.Months] += 1
    assert all(abs(shares[m] - 100) <= 0.01 * cells[m] for m in shares)


def test_full_disjoint_cover_keeps_the_row_count(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    cover = ColumnDefinition("c", "l_quantity", (Category("a", 0, 25), Category("b", 26, 50)))
    assert derive_column(lines, cover).count() == lines.count()
