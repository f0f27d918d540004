"""One query per operator, run on the star-schema tables of a folder.

Each function takes ``(spark, folder)``. ``ORACLE`` in ``checks.oracle`` holds the
equivalent SQL under the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cohortspark.functions as X
from cohortspark.operators import counts, crosstab, distribution, filters, joins, latest, places, reshape
from cohortspark.operators.derive import Category, ColumnDefinition, derive_column, stack
from cohortspark.plans import datasets
from cohortspark.plans.charts import ItemFilter, chart_bar, chart_line, chart_map
from cohortspark.plans.dashboard import PlotSpec, dashboard_rows, run_dashboard
from cohortspark.session import materialize, new_path
from cohortspark.sources import StarSchemaTables, export_csv, read_exported_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = date(1996, 1, 1), date(1998, 12, 31)
AS_OF = date(2024, 1, 1)
MONTHS, QUARTERS, YEARS = "Months", "Quarters", "Years"
VARIABLES = ["BMI", "BMI Status", "FBS", "Hb1AC"]


def query_named(name: str, staged: bool = False) -> Callable:
    """Register a function of the tables under ``name``, as a query over a folder.

    ``staged`` is for queries that read the derived lines several times.
    """

    def register(function: Callable[[StarSchemaTables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: function(
            StarSchemaTables(spark, folder, staged=staged)
        )
        return function

    return register


def query(function: Callable[[StarSchemaTables], DataFrame]) -> Callable:
    return query_named(function.__name__)(function)


def staged_query(function: Callable[[StarSchemaTables], DataFrame]) -> Callable:
    return query_named(function.__name__, staged=True)(function)


# --- sources and sinks ---------------------------------------------------------------


@query
def scan_clinical(t):
    return t.clinical("obs").select(
        "obs_id", "person_id", "concept_id", "value_numeric", "value_text", "obs_datetime"
    )


@query
def scan_billing(t):
    return t.billing("sale_order").select("id", "amount_total", "care_setting")


@query
def sql_source(t):
    return t.sql("SELECT distinct order_id, external_id from sale_order_line")


@query_named("export_csv")
def export_csv_table(t):
    note = F.concat(F.lit("  "), F.col("District"), F.lit('\n"quoted", '), F.col("Gender"), F.lit(" \t"))
    noted = t.visits.withColumn("Note", note)
    path = new_path(t.spark, "export")
    export_csv(noted, path)
    return read_exported_csv(t.spark, path, noted.schema)


@query
def export_crosstab_csv(t):
    path = new_path(t.spark, "export")
    wide = crosstab.crosstab_wide(t.visits, "Diagnosis", "Gender")
    export_csv(wide, path)
    return read_exported_csv(t.spark, path, wide.schema)


# --- filters and projections ---------------------------------------------------------


@query
def filter_active(t):
    return filters.active(t.read("encounter")).select("encounter_id", "visit_id", "uuid")


@query
def filter_in_list(t):
    urgent = filters.where_in(t.base("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return urgent.select("o_orderkey", "o_orderpriority")


@query
def filter_scalar_lookup(t):
    coded = filters.lookup_concept(t.clinical("concept_name"), "Coded Diagnosis")
    obs = t.clinical("obs")
    return obs.where(obs.concept_id == coded).select("obs_id", "person_id", "value_coded")


@query
def filter_date_range(t):
    return filters.in_range(t.visits, "Visit Date", START, END).select("ID", "Visit Date")


@query
def fetch_all_switch(t):
    def rows(label, fetch_all):
        seen = filters.in_range_unless_all(t.visits, "Visit Date", START, END, fetch_all)
        return seen.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("fetch"), "n")

    return stack([rows("all", True), rows("range", False)])


@query
def filter_any_not_null(t):
    kept = filters.any_not_null(t.clinical("obs"), ["value_numeric", "value_text"])
    return kept.select("obs_id", "value_numeric", "value_text")


@query
def project_rename(t):
    return (
        t.clinical("person_address")
        .withColumnRenamed("county_district", "District")
        .withColumnRenamed("state_province", "Home State")
        .select("person_id", "District", "`Home State`")
    )


@query
def select_numeric_columns(t):
    return filters.numeric_summary(t.base("lineitem"))


@query
def table_view(t):
    return filters.table_view(
        t.visits,
        filters={
            "Diagnosis": "HIGH",
            "Gender": ["F", "M"],
            "Amount": (1000.0, 450000.0),
            "Visit Date": (date(1996, 1, 1), date(1997, 12, 31)),
        },
        order_by=[("State", True), ("Amount", False)],
        page=3,
        size=25,
    )


@query
def table_view_deep(t):
    lines = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return filters.table_view(lines, order_by=[("l_shipdate", False), ("l_extendedprice", True)], page=200, size=25)


@query
def table_view_after(t):
    """The page after the last row of 1995."""
    orders = t.base("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    ends = orders.where("o_orderdate < '1996-01-01'").orderBy(F.desc("o_orderdate"), "o_totalprice", F.desc("o_orderkey")).first()
    return filters.table_view(orders, order_by=[("o_orderdate", True), ("o_totalprice", False)], size=40, after=ends.asDict())


# --- joins ---------------------------------------------------------------------------


@query
def join_concept_names(t):
    coded = t.clinical("obs").where("value_coded is not null")
    return joins.with_concept_name(coded, t.clinical("concept_name")).select(
        "obs_id", "value_coded", "name"
    )


@query
def join_patient_dim(t):
    return datasets.patient_dim(t, AS_OF)


@query
def join_left_orders(t):
    uuid = F.when(F.col("encounter_id") % 41 != 0, F.col("uuid")).alias("uuid")
    encounters = t.read("encounter").select("encounter_id", uuid)
    links = t.billing("sale_order_line").distinct()
    return joins.left_null_safe(encounters, links, "uuid", "external_id")


@query
def join_left_amounts(t):
    links = t.billing("sale_order_line").distinct()
    encounters = t.clinical("encounter").select("encounter_id", "uuid")
    billed = joins.left_null_safe(encounters, links, "uuid", "external_id")
    priced = joins.left_on(
        billed.select("encounter_id", "order_id"), t.billing("sale_order"), "order_id", "id"
    )
    return priced.select("encounter_id", "order_id", "amount_total", "care_setting")


@staged_query
def semi_join_ids(t):
    cohort = datasets.find_cohort(t, datasets.DIABETES_CONCEPTS, START, END, False)
    encounters = t.clinical("encounter")
    visits = joins.keep_matching(encounters, cohort, "encounter_id").select("visit_id").distinct()
    return joins.keep_matching(encounters, visits, "visit_id").select("encounter_id", "visit_id")


SIZES = ColumnDefinition(
    "Size",
    "l_quantity",
    (Category("small", 1, 12), Category("medium", 10, 30), Category("large", 31, 45)),
)
DEALS = ColumnDefinition(
    "Deal",
    "l_quantity",
    (
        Category("bulk", 25, 50, 0.05, 0.1),
        Category("plain", 1, 50, 0.0, 0.02),
        Category("tiny bargain", 1, 5, 0.06, 0.1),
    ),
    second="l_discount",
)
LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]


@query
def derive_one_var(t):
    return derive_column(t.base("lineitem").select(LINE), SIZES)


@query
def derive_two_var(t):
    return derive_column(t.base("lineitem").select(LINE), DEALS)


@staged_query
def join_patient_visits(t):
    cohort = datasets.find_cohort(t, datasets.DIABETES_CONCEPTS, START, END, False)
    cohort = materialize(cohort, "cohort")
    return datasets.patient_visit_pairs(t, cohort, VARIABLES)


def known_geocodes(t):
    """Positions of most districts, derived from the nation table."""
    return t.base("nation").selectExpr(
        "n_name as address",
        "cast(n_nationkey * 7 - 80 as double) as lat",
        "cast(n_nationkey * 13 - 160 as double) as lon",
    ).where("lat <> -45")


@query
def join_geocodes(t):
    return joins.with_geocodes(places.place_counts(t.visits, "District"), known_geocodes(t))


@query
def geocode_misses(t):
    counted = places.place_counts(t.visits, "District")
    return joins.unresolved_places(counted, known_geocodes(t), "India")


# --- aggregation ---------------------------------------------------------------------


@query
def count_by_interval(t):
    return counts.interval_counts(t.visits, ["Diagnosis", "Gender"], MONTHS)


@query
def visit_payments(t):
    encounters = t.clinical("encounter").select("visit_id", "uuid")
    return datasets.visit_payments(
        encounters, t.billing("sale_order_line"), t.billing("sale_order")
    )


@query
def distinct_rows(t):
    return t.billing("sale_order_line").select("order_id", "external_id").distinct()


@query
def proportion_by_interval(t):
    counted = counts.interval_counts(t.visits, ["Diagnosis"], MONTHS)
    return counts.with_percentage(counted, MONTHS).select("Diagnosis", MONTHS, "total", "percentage")


@query
def crosstab_one(t):
    return crosstab.crosstab(t.visits, "Gender")


@query
def crosstab_two(t):
    return crosstab.crosstab(t.visits, "ID", "Gender", dense=True)


@query
def crosstab_proportional(t):
    return crosstab.crosstab(t.visits, "Diagnosis", "Gender", proportional=True, dense=True)


def _summaries(t, y):
    items = ItemFilter(n=3)
    frames = []
    for func in counts.SUMMARIES:
        _, summary = chart_line(
            t.visits, ["Diagnosis", "Gender"], QUARTERS, y == "percentage", items, func
        )
        value = F.round("value", 6).alias("value")
        frames.append(summary.select(F.lit(func).alias("func"), QUARTERS, "Gender", value))
    return stack(frames)


@query
def summary_line(t):
    return _summaries(t, "total")


@query
def summary_line_percentage(t):
    return _summaries(t, "percentage")


def _rounded(boxes):
    names = ("q1", "median", "q3", "lower", "upper")
    return boxes.withColumns({name: F.round(name, 4) for name in names})


@query
def box_stats(t):
    return _rounded(distribution.box_stats(t.visits, "Amount", MONTHS))


@query
def box_stats_filled(t):
    return _rounded(distribution.box_stats(t.base("events"), "value", MONTHS, "event_type", ts="ts"))


@query
def box_stats_approximate(t):
    return _rounded(distribution.box_stats(t.visits, "Amount", MONTHS, approximate=True))


@query
def box_outliers(t):
    return distribution.box_outliers(t.base("events"), "value", MONTHS, "event_type", ts="ts")


@query
def histogram_width(t):
    return distribution.histogram(t.base("lineitem"), "l_quantity", 10, fill="l_returnflag")


@query
def histogram_default(t):
    binned = distribution.histogram(t.visits, "Amount")
    return binned.select(F.round("center", 4).alias("center"), "n")


@query
def count_by_place(t):
    return places.place_counts(datasets.patient_dim(t, AS_OF), "State")


@query
def place_argmax(t):
    return places.busiest_place(places.place_counts(t.visits, "District"))


@query
def interval_domain(t):
    return counts.interval_grid(t.visits)


@query
def scatter_points(t):
    return distribution.scatter(t.base("lineitem"), "l_quantity", "l_discount", "l_returnflag")


@query
def scatter_thinned(t):
    return distribution.scatter(t.base("lineitem"), "l_extendedprice", "l_quantity", "l_returnflag", max_points=500)


# --- window, ranking, de-duplication -------------------------------------------------


@query
def latest_with_ties(t):
    newest = latest.latest(t.base("orders"), ["o_custkey"], "o_orderdate")
    return newest.select("o_custkey", "o_orderkey", "o_orderdate")


@query
def latest_with_many_ties(t):
    """Nearly all rows of a group are tied: few dates, and half of all rows in one group."""
    orders = t.base("orders").selectExpr("o_orderkey", "o_orderkey % 2 * (o_custkey % 9) as grp",
                                         "cast(date_trunc('year', o_orderdate) as timestamp_ntz) as yr")
    return latest.latest(orders, ["grp"], "yr").select("grp", "o_orderkey", "yr")


@query
def share_denominator(t):
    counted = counts.interval_counts(t.visits, ["Diagnosis", "Gender"], QUARTERS)
    return counts.with_interval_total(counted, QUARTERS)


def _monthly(t):
    return counts.interval_counts(t.visits, ["Diagnosis", "Gender"], MONTHS)


@query
def top_items(t):
    return counts.top_items(_monthly(t), [MONTHS, "Gender"], ["Diagnosis", "Gender"], n=2)


@query
def top_items_strict(t):
    return counts.top_items(
        _monthly(t), [MONTHS, "Gender"], ["Diagnosis", "Gender"], n=2, mode="strict"
    )


@query
def bottom_items(t):
    counted = counts.interval_counts(t.visits, ["District"], QUARTERS)
    return counts.bottom_items(counted, [QUARTERS], ["District"], n=5)


@query
def dedup_keep_first(t):
    lines = t.base("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    order = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"]
    return latest.first_per(lines, ["l_orderkey", "l_linenumber"], [F.col(name) for name in order])


# --- set operations and reshaping ----------------------------------------------------


@query
def union_categories(t):
    lines = t.base("lineitem").select(LINE)
    copies = []
    for category in SIZES.categories:
        name = X.if_between(F.col("l_quantity"), category.low, category.high, category.name)
        copies.append(lines.withColumn("Size", name).where(F.col("Size").isNotNull()))
    return stack(copies)


@query
def unpivot_values(t):
    obs = t.clinical("obs").select("obs_id", "value_coded", "value_numeric", "value_text")
    return reshape.unpivot_values(obs, ["obs_id"])


@query
def pivot_variables(t):
    values = filters.any_not_null(
        datasets.observations(t, VARIABLES), ["value_numeric", "value_text"]
    )
    values = latest.first_per(values, ["person_id", "name"], [F.col("obs_id")])
    return reshape.pivot_variables(values, ["person_id"], datasets.DIABETES_VARIABLES)


@query
def retype_columns(t):
    texts = t.clinical("obs").selectExpr(
        "obs_id",
        "cast(cast(value_numeric as int) as string) as whole",
        "concat(cast(obs_id as string), '.5') as number",
        "case when concept_id = 1 then 'TRUE' when concept_id = 20 then 'FALSE' end as flag",
        "coalesce(value_text, cast(concept_id as string)) as mixed",
    )
    return reshape.retype(texts, ["whole", "number", "flag", "mixed"])


# --- scalar functions ----------------------------------------------------------------


@query
def age_years(t):
    visits = t.clinical("visit").join(
        t.clinical("person"), F.col("patient_id") == F.col("person_id")
    )
    at_visit = X.age_years(F.col("birthdate"), F.col("date_started").cast("date"))
    today = X.age_years(F.col("birthdate"), F.lit(AS_OF))
    return visits.select("visit_id", at_visit.alias("age_at_visit"), today.alias("age"))


@query
def parse_date(t):
    text = "case when voided = 1 then 'unknown' else cast(birthdate as string) end as text"
    people = t.read("person").selectExpr("person_id", text)
    return people.select("person_id", X.parse_date(F.col("text")).alias("birthdate"))


@query
def parse_datetime(t):
    text = (
        "case when voided = 1 then date_format(date_started, 'yyyy-MM-dd') "
        "else date_format(date_started, 'yyyy-MM-dd HH:mm:ss') end as text"
    )
    visits = t.read("visit").selectExpr("visit_id", text)
    return visits.select("visit_id", X.parse_datetime(F.col("text")).alias("started"))


def _bucketed(t, interval):
    events = t.base("events")
    return events.select("event_id", X.bucket(F.col("ts"), interval).alias("bucket")).union(
        t.base("orders").select("o_orderkey", X.bucket(F.col("o_orderdate"), interval))
    )


@query
def bucket_year(t):
    return _bucketed(t, YEARS)


@query
def bucket_quarter(t):
    return _bucketed(t, QUARTERS)


@query
def bucket_month(t):
    return _bucketed(t, MONTHS)


@query
def bucket_label(t):
    labels = [
        counts.with_label(counts.interval_counts(t.visits, ["Gender"], interval), interval).select(
            "Gender", "label", "total"
        )
        for interval in (YEARS, QUARTERS, MONTHS)
    ]
    return stack(labels)


@query
def ceil_year(t):
    started = F.col("o_orderdate")
    return t.base("orders").select("o_orderkey", X.ceil_year(started).alias("year_end"))


@query
def date_grid(t):
    ends = t.visits.groupBy("Gender").agg(
        F.min("Visit Date").alias("first"), F.max("Visit Date").alias("last")
    )
    first, last = X.bucket(F.col("first"), YEARS), X.ceil_year(F.col("last"))
    return ends.select("Gender", F.explode(X.quarter_grid(first, last)).alias("tick"))


@query
def round_percent(t):
    cells = counts.interval_counts(t.visits, ["Diagnosis", "Gender"], MONTHS)
    shared = counts.with_interval_total(cells, MONTHS)
    return shared.select(
        "total", "countT", X.round_percent(F.col("total"), F.col("countT")).alias("percentage")
    )


@query
def if_between(t):
    level = X.if_between(F.col("l_quantity"), 10, 20, "middle")
    return t.base("lineitem").select("l_orderkey", "l_linenumber", level.alias("level"))


@query
def is_missing(t):
    number, text = F.col("value_numeric"), F.col("value_text")
    return t.clinical("obs").select(
        "obs_id",
        X.is_missing(number).alias("no_number"),
        X.any_present(number, text).alias("has_value"),
    )


@query
def day_arith(t):
    day = F.col("o_orderdate").cast("date")
    return t.base("orders").select(
        "o_orderkey",
        X.add_days(day, 1).alias("following"),
        X.range_start_default(day).alias("year_before"),
    )


# --- datasets, charts, extension points ----------------------------------------------


@query
def dataset_general(t):
    return datasets.fetch("general", t, START, END, as_of=AS_OF)


@staged_query
def dataset_diabetes(t):
    return datasets.fetch("diabetes", t, START, END, as_of=AS_OF)


@staged_query
def dataset_hypertension(t):
    return datasets.fetch("hypertension", t, START, END, as_of=AS_OF)


@staged_query
def dataset_diabetes_all(t):
    return datasets.fetch("diabetes", t, fetch_all=True, as_of=AS_OF)


@datasets.dataset("visits")
def visits_dataset(tables, start, end, fetch_all=False, as_of=None):
    """A user-written dataset: one row per visit."""
    return filters.in_range_unless_all(tables.visits, "Visit Date", start, end, fetch_all)


@query
def user_dataset(t):
    return datasets.fetch("visits", t, START, END)


@query
def runtime_columns(t):
    names = [name for name in t.visits.columns if " " in name]
    return t.visits.groupBy(*map(filters.quoted, names)).agg(F.count(F.lit(1)).alias("n"))


@query
def summary_by_name(t):
    counted = counts.interval_counts(t.visits, ["District"], YEARS)
    lines = [
        counts.summary_line(counted, YEARS, name).select(
            F.lit(name).alias("func"), YEARS, F.round("value", 6).alias("value")
        )
        for name in ("mean", "sd")
    ]
    return stack(lines)


PLOTS = [
    PlotSpec("Visits", "Bar Chart", "Diagnosis", "Gender", MONTHS),
    PlotSpec("Share of settings", "Line Chart", "Care Setting", None, QUARTERS, True),
    PlotSpec("Price classes", "Bar Chart", "Price", "State", YEARS, True),
    PlotSpec("Amounts", "Histogram", "Amount", "Care Setting"),
    PlotSpec("Amount by year", "Box Plot", "Amount", "State", YEARS),
    PlotSpec("Districts", "Map Plot", "District"),
    PlotSpec("Ignored", "Table", "Gender"),
]
PRICES = ColumnDefinition(
    "Price",
    "Amount",
    (Category("low", 0, 150000), Category("middle", 100000, 300000), Category("high", 300001, 450000)),
)


@query_named("run_dashboard")
def run_dashboard_plots(t):
    charts = run_dashboard(t, "visits", PLOTS, START, END, {"Price": PRICES}, known_geocodes(t))
    rows = dashboard_rows(PLOTS, charts)
    return rows.withColumn("value", F.round("value", 4))


@query_named("chart_bar")
def chart_bar_share(t):
    return chart_bar(t.visits, ["Diagnosis", "State"], QUARTERS, True, ItemFilter(n=2))


@query_named("chart_line")
def chart_line_items(t):
    lines, _ = chart_line(t.visits, ["Diagnosis"], MONTHS, False, ItemFilter(3, ascending=True))
    return lines


@query_named("chart_map")
def chart_map_places(t):
    return chart_map(t.visits, "District", known_geocodes(t)).places


@query
def chart_map_center(t):
    return chart_map(t.visits, "State", known_geocodes(t)).center
