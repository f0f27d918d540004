"""The datasets: flat tables of patients built from the source tables.

A dataset is a function ``(tables, start, end, fetch_all, as_of) -> DataFrame``. Users add
their own with the ``dataset`` decorator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import age_years, nulls_last, strict_sum
from cohortspark.operators.filters import (
    any_not_null,
    full_concept_names,
    in_range_unless_all,
    quoted,
    single_concept,
    where_in,
)
from cohortspark.operators.joins import (
    keep_matching,
    keep_matching_null_safe,
    left_null_safe,
    left_on,
    where_concept,
    with_concept_name,
)
from cohortspark.operators.latest import repeat_rows
from cohortspark.operators.reshape import pivot_variables
from cohortspark.session import materialize
from cohortspark.sources.tables import Tables

DatasetFunction = Callable[..., DataFrame]
DATASETS: dict[str, DatasetFunction] = {}

# Names in the concept dictionary, and the identifier type of a patient id.
CODED_DIAGNOSIS = "Coded Diagnosis"
DIABETES_CONCEPTS = (
    "Diabetes, Type 1",
    "Diabetes, Type 2",
    "Diabetes I, uncomplicated",
    "Diabetes, Juvenile",
    "Diabetes II, uncomplicated",
)
HYPERTENSION_CONCEPTS = ("Hypertension",)
DIABETES_VARIABLES = {"BMI": "double", "BMI Status": "string", "FBS": "double", "Hb1AC": "double"}
HYPERTENSION_VARIABLES = {
    "BMI": "double",
    "BMI Status": "string",
    "Systolic": "double",
    "Diastolic": "double",
}
PATIENT_COLUMNS = ("Age", "State", "District", "Gender", "Visit Date", "Amount", "Care Setting")
PATIENT_SCHEMA = (
    "ID string, Age int, State string, District string, Gender string, "
    "`Visit Date` timestamp_ntz, Amount double, `Care Setting` string"
)
PATIENT_ID_TYPE = 3


def dataset(name: str) -> Callable[[DatasetFunction], DatasetFunction]:
    """Register a dataset function under ``name``."""

    def register(function: DatasetFunction) -> DatasetFunction:
        DATASETS[name] = function
        return function

    return register


def fetch(
    name: str,
    tables: Tables,
    start: date | None = None,
    end: date | None = None,
    fetch_all: bool = False,
    as_of: date | None = None,
) -> DataFrame:
    """The dataset called ``name`` for the days ``start`` to ``end``, both included.

    Ages are those on ``as_of``, by default today.
    """
    if name not in DATASETS:
        raise ValueError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    if not fetch_all and (start is None or end is None):
        raise ValueError("a start and an end date are needed unless fetch_all is set")
    return DATASETS[name](tables, start, end, fetch_all, as_of)


@dataset("general")
def general(
    tables: Tables,
    start: date | None,
    end: date | None,
    fetch_all: bool = False,
    as_of: date | None = None,
) -> DataFrame:
    """The latest occurrence in range of every coded diagnosis of every patient."""
    coded = _coded_diagnoses(tables)
    seen = in_range_unless_all(coded, "obs_datetime", start, end, fetch_all)
    # Written, so its size is known before persons, addresses and identifiers are narrowed to it.
    diagnoses = materialize(_latest_counted(seen, ["person_id", "value_coded"]), "diagnoses")
    named = with_concept_name(diagnoses, tables.clinical("concept_name"))
    described = patient_dim(tables, as_of, diagnoses).join(named, "person_id")
    return repeat_rows(described, "n").select(
        F.col("identifier").alias("ID"),
        "Gender",
        "Age",
        "District",
        "State",
        F.col("obs_datetime").alias("Visit Date"),
        F.col("name").alias("Diagnosis"),
    )


@dataset("diabetes")
def diabetes(
    tables: Tables,
    start: date | None,
    end: date | None,
    fetch_all: bool = False,
    as_of: date | None = None,
) -> DataFrame:
    """Patients with a diabetes diagnosis in range, a visit of theirs, and measurements."""
    cohort = find_cohort(tables, DIABETES_CONCEPTS, start, end, fetch_all)
    return cohort_dataset(tables, cohort, first_values, DIABETES_VARIABLES, as_of)


@dataset("hypertension")
def hypertension(
    tables: Tables,
    start: date | None,
    end: date | None,
    fetch_all: bool = False,
    as_of: date | None = None,
) -> DataFrame:
    """Patients with a hypertension diagnosis in range, a visit, and latest measurements."""
    cohort = find_cohort(tables, HYPERTENSION_CONCEPTS, start, end, fetch_all)
    return cohort_dataset(tables, cohort, latest_values, HYPERTENSION_VARIABLES, as_of)


def patient_dim(tables: Tables, as_of: date | None = None, within: DataFrame | None = None) -> DataFrame:
    """``person_id, Gender, Age, District, State, identifier``.

    Several addresses or identifiers give several rows; a person without either has none. ``within``:
    only persons whose ``person_id`` it holds; each table is then narrowed before it is joined.
    """
    parts = [_persons(tables, as_of), _addresses(tables), _identifiers(tables)]
    if within is not None:
        parts = [keep_matching(part, within, "person_id") for part in parts]
    return parts[0].join(parts[1], "person_id").join(parts[2], "person_id")


def find_cohort(
    tables: Tables,
    concept_names: Sequence[str],
    start: date | None,
    end: date | None,
    fetch_all: bool,
) -> DataFrame:
    """``person_id, encounter_id`` of the diagnoses in range."""
    diagnosed = where_concept(_coded_diagnoses(tables), "value_coded", _named(tables, concept_names))
    seen = in_range_unless_all(diagnosed, "obs_datetime", start, end, fetch_all)
    return seen.select("person_id", "encounter_id").distinct()


def visit_payments(encounters: DataFrame, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """``visit_id, care_setting, Amount``: the sum of a visit's orders per care setting.

    An order counts once per visit. The amount is NULL when one of them is unknown;
    encounters without an order give their visit a row without care setting and amount.
    """
    billed = left_null_safe(encounters, lines.select("order_id", "external_id"), "uuid", "external_id")
    ordered = billed.select("visit_id", "order_id").distinct()
    priced = left_on(ordered, orders.select("id", "amount_total", "care_setting"), "order_id", "id")
    return priced.groupBy("visit_id", "care_setting").agg(
        strict_sum(F.col("amount_total")).alias("Amount")
    )


def cohort_visits(tables: Tables, cohort: DataFrame) -> DataFrame:
    """``patient_id, Visit Date, Care Setting, Amount`` of the visits with a diagnosis."""
    encounters = tables.clinical("encounter")
    diagnosed = keep_matching(encounters, cohort, "encounter_id")
    # Used twice below: written once, so the encounters are not matched to the cohort again.
    visits = materialize(diagnosed.select("visit_id", "patient_id").distinct(), "visits")
    # Billing is narrowed step by step: own encounters, their order lines, their orders.
    own = keep_matching(encounters, visits, "visit_id").select("visit_id", "uuid")
    own = materialize(own, "encounters")
    lines = tables.billing("sale_order_line").select("order_id", "external_id")
    lines = materialize(keep_matching_null_safe(lines, own, "external_id", "uuid"), "order-lines")
    orders = keep_matching(tables.billing("sale_order"), lines, "id", "order_id")
    payments = visit_payments(own, lines, orders)
    dates = tables.clinical("visit").select("visit_id", "date_started")
    return visits.join(dates, "visit_id").join(payments, "visit_id").select(
        "patient_id",
        F.col("date_started").alias("Visit Date"),
        F.col("care_setting").alias("Care Setting"),
        "Amount",
    )


def first_values(observed: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``person_id`` and a column per variable with its first recorded value.

    The columns are structs of ``obs_id, value_numeric, value_text``.
    """
    recorded = any_not_null(observed, ["value_numeric", "value_text"])
    return _pack(recorded, variables)


def latest_values(observed: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Like ``first_values`` with the latest values, which may be NULL.

    Of several at the same time the first recorded one counts. A concept with a value at an
    unknown time has no latest one.
    """
    latest = F.max(
        F.struct(
            F.col("obs_datetime").isNull().alias("undated"),
            F.col("obs_datetime"),
            (-F.col("obs_id")).alias("newest_first"),
            F.col("value_numeric"),
            F.col("value_text"),
        )
    )
    per_concept = (
        observed.groupBy("person_id", "concept_id", "name")
        .agg(latest.alias("latest"))
        .where(~F.col("latest.undated"))
        .select(
            "person_id",
            "name",
            (-F.col("latest.newest_first")).alias("obs_id"),
            "latest.value_numeric",
            "latest.value_text",
        )
    )
    return _pack(per_concept, variables)


def patient_visit_pairs(tables: Tables, cohort: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``person_id, name, n``: how many (observation, patient row) pairs each variable has.

    A patient row is a visit of a cohort patient with one of their addresses and
    identifiers. The pairs themselves are never formed: the counts multiply.
    """
    own = keep_matching(observations(tables, variables), cohort, "person_id")
    observed = own.groupBy("person_id", "name").agg(F.count(F.lit(1)).alias("observations"))
    visits = _count_by(cohort_visits(tables, cohort), "patient_id", "visits")
    persons = keep_matching(tables.clinical("person"), cohort, "person_id").select("person_id")
    addresses = keep_matching(tables.clinical("person_address"), cohort, "person_id")
    addresses = _count_by(addresses, "person_id", "addresses")
    identifiers = _count_by(keep_matching(_identifiers(tables), cohort, "person_id"), "person_id", "identifiers")
    return (
        observed.join(persons, "person_id")
        .join(visits.withColumnRenamed("patient_id", "person_id"), "person_id")
        .join(addresses, "person_id")
        .join(identifiers, "person_id")
        .select(
            "person_id",
            "name",
            F.expr("observations * visits * addresses * identifiers").alias("n"),
        )
    )


def cohort_dataset(
    tables: Tables,
    cohort: DataFrame,
    pick_values: Callable[[DataFrame, Sequence[str]], DataFrame],
    variables: dict[str, str],
    as_of: date | None,
) -> DataFrame:
    """One row per patient: demographics, first visit with its payment, one value each.

    Every variable would be paired with all visits of its patient only to keep the first
    pair, so the first visit and the first address are chosen before the join. "First" is
    by visit date, care setting, amount, district and state, missing ones last.
    """
    # Written, so Spark knows its size: every table is narrowed to the cohort first, while it is
    # read where the cohort is small.
    cohort = materialize(cohort, "cohort")
    if cohort.limit(1).count() == 0:
        return _nobody(tables.spark, variables)
    observed = keep_matching(observations(tables, list(variables)), cohort, "person_id")
    values = pick_values(observed, list(variables))
    visits = _first_of(
        cohort_visits(tables, cohort).withColumnRenamed("patient_id", "person_id"),
        ["Visit Date", "Care Setting", "Amount"],
    )
    addresses = _first_of(keep_matching(_addresses(tables), cohort, "person_id"), ["District", "State"])
    persons = keep_matching(_persons(tables, as_of), cohort, "person_id")
    patients = persons.join(visits, "person_id").join(addresses, "person_id")
    identifiers = keep_matching(_identifiers(tables), cohort, "person_id")
    measured = values.join(patients, "person_id").join(identifiers, "person_id")
    # One value per identifier and variable, also when persons share an identifier. The
    # pivot that follows keeps the partitioning by identifier, so it needs no shuffle.
    described = list(PATIENT_COLUMNS)
    chosen = [
        F.min(
            F.when(
                quoted(name).isNotNull(),
                F.struct(
                    F.col(f"`{name}`.obs_id"),
                    F.lit(name).alias("name"),
                    F.col(f"`{name}`.value_numeric"),
                    F.col(f"`{name}`.value_text"),
                    *map(quoted, described),
                ),
            )
        ).alias(name)
        for name in variables
    ]
    owned = measured.groupBy("identifier").agg(*chosen)
    rows = owned.select("identifier", F.explode(F.array(*map(quoted, variables))).alias("row"))
    known = any_not_null(rows.select("identifier", "row.*"), ["value_numeric", "value_text"])
    wide = pivot_variables(known, ["identifier", *described], variables)
    return wide.select(
        F.col("identifier").alias("ID"), *map(quoted, PATIENT_COLUMNS), *map(quoted, variables)
    )


def _nobody(spark: SparkSession, variables: dict[str, str]) -> DataFrame:
    measured = ", ".join(f"`{name}` {kind}" for name, kind in variables.items())
    return spark.createDataFrame([], f"{PATIENT_SCHEMA}, {measured}")


def observations(tables: Tables, variables: Sequence[str]) -> DataFrame:
    """The observations of the named variables, with the name of each."""
    named: dict[int, list[str]] = {}
    for concept_id, name in _named(tables, variables).collect():
        named.setdefault(concept_id, []).append(name)
    obs = tables.clinical("obs").where(F.col("concept_id").isin(sorted(named)))
    # A handful of names, looked up above: a literal map in place of a join on a few hot keys.
    cases = F.array().cast("array<string>")
    for concept_id, names in sorted(named.items()):
        cases = F.when(F.col("concept_id") == concept_id, F.array(*map(F.lit, sorted(names)))).otherwise(cases)
    return obs.withColumn("name", F.explode(cases)).select(
        "person_id", "concept_id", "name", "obs_id", "obs_datetime", "value_numeric", "value_text"
    )


def _pack(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per person with the first row of each variable as a struct."""
    row = F.struct("obs_id", "value_numeric", "value_text")
    return rows.groupBy("person_id").agg(
        *[F.min(F.when(F.col("name") == name, row)).alias(name) for name in variables]
    )


def _coded_diagnoses(tables: Tables) -> DataFrame:
    coded = single_concept(tables.clinical("concept_name"), CODED_DIAGNOSIS)
    return tables.clinical("obs").where(F.col("concept_id") == coded).select(
        "person_id", "encounter_id", "value_coded", "obs_datetime"
    )


def _latest_counted(seen: DataFrame, keys: Sequence[str], ts: str = "obs_datetime") -> DataFrame:
    """Per group the latest time and the number ``n`` of rows tied there.

    Counting first and taking the maximum of the counts keeps both steps pre-aggregated,
    however many rows one group has. A group with a missing time is left out.
    """
    counted = seen.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.groupBy(*keys).agg(
        F.max(ts).alias(ts),
        F.max_by("n", ts).alias("n"),
        F.bool_or(F.col(ts).isNull()).alias("undated"),
    )
    return grouped.where(~F.col("undated")).select(*keys, ts, "n")


def _named(tables: Tables, names: Sequence[str]) -> DataFrame:
    return where_in(full_concept_names(tables.clinical("concept_name")), "name", names)


def _persons(tables: Tables, as_of: date | None) -> DataFrame:
    return tables.clinical("person").select(
        "person_id",
        F.col("gender").alias("Gender"),
        age_years(F.col("birthdate").cast("date"), _day(as_of)).alias("Age"),
    )


def _addresses(tables: Tables) -> DataFrame:
    return tables.clinical("person_address").select(
        "person_id",
        F.col("county_district").alias("District"),
        F.col("state_province").alias("State"),
    )


def _identifiers(tables: Tables) -> DataFrame:
    return (
        tables.clinical("patient_identifier")
        .where(F.col("identifier_type") == PATIENT_ID_TYPE)
        .select(F.col("patient_id").alias("person_id"), "identifier")
    )


def _day(as_of: date | None) -> Column:
    return F.lit(as_of) if as_of is not None else F.current_date()


def _first_of(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per person the least row by ``order``, missing values last, as a plain minimum."""
    least = F.min(F.struct(*[nulls_last(F.col(f"`{name}`")).alias(name) for name in order]))
    return df.groupBy("person_id").agg(least.alias("least")).select(
        "person_id", *[F.col(f"least.`{name}`.value").alias(name) for name in order]
    )


def _count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
