from cohortspark.functions.dates import (
    INTERVALS,
    add_days,
    age_years,
    bucket,
    bucket_label,
    ceil_year,
    parse_date,
    parse_datetime,
    quarter_grid,
    range_start_default,
)
from cohortspark.functions.values import (
    any_present,
    if_between,
    is_missing,
    nulls_last,
    round_percent,
    strict_sum,
)

__all__ = [
    "INTERVALS",
    "add_days",
    "age_years",
    "any_present",
    "bucket",
    "bucket_label",
    "ceil_year",
    "if_between",
    "is_missing",
    "nulls_last",
    "parse_date",
    "parse_datetime",
    "quarter_grid",
    "range_start_default",
    "round_percent",
    "strict_sum",
]
