"""Patient cohorts, derived columns and chart tables on Spark."""

from cohortspark.plans.charts import ItemFilter, chart_bar, chart_line, chart_map
from cohortspark.plans.dashboard import PlotSpec, dashboard_rows, run_dashboard
from cohortspark.plans.datasets import DATASETS, dataset, fetch
from cohortspark.session import get_session

__all__ = [
    "DATASETS",
    "ItemFilter",
    "PlotSpec",
    "chart_bar",
    "chart_line",
    "chart_map",
    "dashboard_rows",
    "dataset",
    "fetch",
    "get_session",
    "run_dashboard",
]
