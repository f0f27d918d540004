"""Charts and dashboards: composed tables equal the operators run one by one."""

from datetime import date

import pytest
from clinical import clinical_tables

from checks.queries import END, PLOTS, PRICES, START, known_geocodes
from cohortspark.operators import counts
from cohortspark.operators.derive import Category, ColumnDefinition, derive_column
from cohortspark.operators.distribution import box_stats, histogram
from cohortspark.plans import dashboard
from cohortspark.plans.charts import ItemFilter, chart_bar, chart_line, chart_map
from cohortspark.plans.dashboard import PlotSpec, count_tables, dashboard_rows, run_dashboard, run_plot
from cohortspark.plans.datasets import fetch
from cohortspark.session import materialize
from cohortspark.sources import StarSchemaTables


@pytest.fixture(scope="module")
def tables(spark):
    return StarSchemaTables(spark, "/root/testdata/sf0.001")


def test_dashboard_equals_the_charts_run_directly(spark, tables, rows):
    charts = run_dashboard(tables, "visits", PLOTS, START, END, {"Price": PRICES}, known_geocodes(tables))
    extra = {"Amount by year / outliers", "Districts / center", "Districts / to look up"}
    assert set(charts) == {plot.title for plot in PLOTS if plot.type != "Table"} | extra
    assert charts["Districts / center"].count() == 1 and charts["Districts / to look up"].count() == 1
    flat = fetch("visits", tables, START, END)
    direct = {
        "Visits": chart_bar(flat, ["Diagnosis", "Gender"], "Months"),
        "Share of settings": chart_line(flat, ["Care Setting"], "Quarters", True)[0],
        "Price classes": chart_bar(derive_column(flat, PRICES), ["Price", "State"], "Years", True),
        "Amounts": histogram(flat, "Amount", fill="Care Setting"),
        "Amount by year": box_stats(flat, "Amount", "Years", "State"),
        "Districts": chart_map(flat, "District", known_geocodes(tables)).places,
    }
    for title, chart in direct.items():
        assert rows(charts[title]) == rows(chart), title
    long = dashboard_rows(PLOTS, charts)
    assert long.columns == ["title", "factor1", "factor2", "bucket", "measure", "value"]
    assert long.where("title = 'Visits'").count() == direct["Visits"].count()


def test_plots_have_ranges_of_their_own(spark, tables):
    plots = [PlotSpec("all", "Bar Chart", "Gender"), PlotSpec("day", "Bar Chart", "Gender")]
    day = (date(1995, 3, 1), date(1995, 3, 31))
    charts = run_dashboard(tables, "visits", plots, START, END, ranges={"day": day})
    total = {title: sum(row.total for row in chart.collect()) for title, chart in charts.items()}
    assert total["all"] == fetch("visits", tables, START, END).count()
    assert total["day"] == fetch("visits", tables, *day).count()


def test_scatter_and_map_without_positions(spark, tables, rows):
    plots = [
        PlotSpec("s", "Scatter Plot", "Amount", "Amount"),
        PlotSpec("m", "Map Plot", "State"),
    ]
    charts = run_dashboard(tables, "visits", plots, START, END)
    assert sum(row.n for row in charts["s"].collect()) == fetch("visits", tables, START, END).count()
    assert {row.lat for row in charts["m"].collect()} == {None}


def test_dashboard_on_a_disease_dataset(spark, rows):
    plots = PlotSpec.all_from_json(
        """{"By gender": {"factor1": "Gender", "timeInterval": "Months", "isProportional": false,
              "type": "Bar Chart"},
            "Seen": {"factor1": "Gender", "factor2": "State", "timeInterval": "Years",
              "isProportional": true, "type": "Table"}}"""
    )
    charts = run_dashboard(
        clinical_tables(spark), "diabetes", plots, date(2017, 1, 1), date(2017, 12, 31)
    )
    assert list(charts) == ["By gender"]
    assert sum(row.total for row in charts["By gender"].collect()) == 4


@pytest.mark.parametrize(
    "spec",
    [
        {"type": "Bar Chart", "timeInterval": "Years"},
        {"type": "Pie", "factor1": "Gender"},
        {"type": "Bar Chart", "factor1": "Gender", "timeInterval": "Days"},
        {"type": "Scatter Plot", "factor1": "Age"},
    ],
)
def test_incomplete_plots(spec):
    with pytest.raises(ValueError):
        PlotSpec.from_spec("plot", spec)
    with pytest.raises(ValueError):
        PlotSpec("", "Bar Chart", "Gender")


def test_line_chart_summary_works_on_the_filtered_items(spark, tables, rows):
    lines, summary = chart_line(
        tables.visits, ["Diagnosis", "Gender"], "Years", items=ItemFilter(2, mode="strict"), func="sum"
    )
    by_hand = counts.summary_line(lines, "Years", "sum", facet="Gender")
    assert rows(summary) == rows(by_hand)
    assert chart_line(tables.visits, ["Diagnosis"], "Years")[1] is None
    with pytest.raises(ValueError, match="factors"):
        chart_bar(tables.visits, [], "Years")


def test_map_chart(spark, tables, rows):
    chart = chart_map(tables.visits, "District", known_geocodes(tables))
    placed, missing = rows(chart.places, "place"), rows(chart.unresolved)
    assert len(placed) == 25 and len(missing) == 1
    assert missing[0][1] == f"India {missing[0][0]}"
    most = max(row.total for row in chart.places.collect())
    assert chart.center.first().total == most


def test_all_counts_come_from_one_pass(spark, tables, rows):
    flat = materialize(fetch("visits", tables, START, END), "flat")
    columns = {
        "Class": ColumnDefinition("Class", "Amount", (Category("lo", 0, 150000), Category("all", 0, 450000), Category("hi", 120000, 450000))),
        "Size": ColumnDefinition("Size", "Amount", (Category("s", 0, 100000), Category("m", 50000, 300000))),
    }
    plots = [
        PlotSpec("a", "Bar Chart", "Gender", "State", "Months"), PlotSpec("b", "Line Chart", "Class", None, "Years", True),
        PlotSpec("c", "Bar Chart", "Class", "Size", "Months"), PlotSpec("d", "Map Plot", "District"),
        PlotSpec("e", "Bar Chart", "Gender", "Class", "Months"), PlotSpec("f", "Bar Chart", "Gender", None, "Years"),
    ]
    counted = count_tables(flat, plots, columns)
    for plot in plots:
        one_by_one = run_plot(flat, plot, columns)[""]
        got = dashboard._plot_of_counts(counted[plot.title], plot, None)[""]
        assert got.columns == one_by_one.columns and rows(got) == rows(one_by_one), plot.title
        assert rows(got)
    with pytest.raises(ValueError, match="map"):
        count_tables(flat, [PlotSpec("x", "Map Plot", "Gender")], {})


def test_the_kept_table_is_scanned_once_for_the_counts(spark, tables):
    plots = [PlotSpec("a", "Bar Chart", "Gender"), PlotSpec("b", "Line Chart", "State"), PlotSpec("c", "Map Plot", "District")]
    charts = run_dashboard(tables, "visits", plots, START, END)
    for chart in charts.values():
        files = chart.inputFiles()
        assert files and all("/counts-" in f for f in files)
