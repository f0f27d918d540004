"""The three datasets on tables small enough to work out by hand."""

from datetime import date

import pytest
from clinical import TABLES, at, clinical_tables

from cohortspark.plans import datasets

YEAR = (date(2017, 1, 1), date(2017, 12, 31))
AS_OF = date(2018, 2, 28)


def fetch(spark, name, period=YEAR, tables=None, **options):
    tables = tables or clinical_tables(spark)
    return datasets.fetch(name, tables, *period, as_of=AS_OF, **options)


def by_id(df):
    return {row.ID: row for row in df.collect()}


def test_general(spark, rows):
    got = rows(fetch(spark, "general"), "ID", "Age", "District", "`Visit Date`", "Diagnosis")
    first, both = at("2017-03-01 09:00:00"), []
    for district in ("North", "East"):
        both.append(("P1", 17, district, first, "Diabetes, Type 1"))
        both.append(("P1", 17, district, at("2017-03-01 10:00:00"), "Diabetes, Type 2"))
        # two tied rows, two names
        both += [("P1", 17, district, first, name) for name in ("Malaria", "Paludism")] * 2
    for shown in ("P2", "SHARED"):
        both.append((shown, 37, "South", at("2017-05-01"), "Diabetes, Type 1"))
        both.append((shown, 37, "South", at("2017-05-01"), "Hypertension"))
    both.append(("SHARED", 28, "West", at("2017-04-01"), "Hypertension"))
    both.append(("SHARED", 28, "West", at("2017-04-01"), "Diabetes, Type 1"))
    assert got == sorted(both, key=repr)


def test_latest_is_the_latest_in_range(spark, rows):
    january = fetch(spark, "general", (date(2017, 1, 1), date(2017, 1, 31)))
    assert rows(january, "ID", "`Visit Date`") == [
        ("P2", at("2017-01-31 23:59:59")), ("SHARED", at("2017-01-31 23:59:59")),
    ]


def test_fetching_all_drops_diagnoses_with_a_missing_time(spark, rows):
    everything = fetch(spark, "general", (None, None), fetch_all=True)
    assert ("P2", "Hypertension") not in rows(everything, "ID", "Diagnosis")
    assert ("SHARED", "Hypertension") in rows(everything, "ID", "Diagnosis")
    with pytest.raises(ValueError, match="start"):
        fetch(spark, "general", (None, None))


def test_diabetes(spark):
    got = by_id(fetch(spark, "diabetes"))
    assert set(got) == {"P1", "P2", "SHARED"}
    p1 = got["P1"]
    # East comes before North; the order counts once though two encounters name it
    assert (p1.Age, p1.State, p1.District, p1.Gender) == (17, None, "East", "F")
    assert (p1["Visit Date"], p1.Amount, p1["Care Setting"]) == (at("2017-03-01"), 10.25, "OPD")
    assert (p1.BMI, p1["BMI Status"], p1.FBS, p1.Hb1AC) == (22.5, "Normal", None, None)
    # the earliest visit has no order
    p2 = got["P2"]
    assert (p2["Visit Date"], p2.Amount, p2["Care Setting"]) == (at("2017-01-15"), None, None)
    assert (p2.BMI, p2.FBS) == (None, 99.0)


def test_an_identifier_shared_by_two_persons_gets_one_value_per_variable(spark):
    shared = [row for row in fetch(spark, "diabetes").collect() if row.ID == "SHARED"]
    cells = {(row.Age, row.FBS, row.Hb1AC) for row in shared}
    assert cells == {(37, 99.0, None), (28, None, 6.5)}


def test_hypertension(spark):
    got = [row for row in fetch(spark, "hypertension").collect()]
    # person 2 only has a latest value that is missing
    assert [(row.ID, row.Age) for row in got] == [("SHARED", 28)]
    row = got[0]
    # latest systolic is missing, of two diastolic the first, BMI has an unknown time
    assert (row.Systolic, row.Diastolic, row.BMI) == (None, 80.0, None)
    assert (row.Amount, row["Care Setting"]) == (7.5, None)


def test_amounts_of_a_visit(spark, rows):
    tables = clinical_tables(spark)
    encounters = tables.clinical("encounter").select("visit_id", "uuid")
    payments = datasets.visit_payments(
        encounters, tables.billing("sale_order_line"), tables.billing("sale_order")
    )
    assert rows(payments, "visit_id", "care_setting", "Amount") == [
        (100, "OPD", 10.25), (100, None, None), (200, "IPD", None), (201, None, None),
        (300, None, 7.5),
    ]


def test_an_empty_cohort_has_the_same_columns(spark):
    nobody = fetch(spark, "diabetes", (date(1990, 1, 1), date(1990, 1, 2)))
    assert nobody.count() == 0
    assert nobody.schema.simpleString() == fetch(spark, "diabetes").schema.simpleString()


@pytest.mark.parametrize("emptied", ["visit", "encounter", "person", "patient_identifier", "obs"])
def test_a_cohort_that_loses_all_its_rows_on_the_way(spark, emptied):
    kept = [row for row in TABLES["obs"] if row[3] == 1] if emptied == "obs" else []
    assert fetch(spark, "diabetes", tables=clinical_tables(spark, **{emptied: kept})).count() == 0


def test_without_a_billing_database(spark):
    got = by_id(fetch(spark, "diabetes", tables=clinical_tables(spark, without_billing=True)))
    assert got["P1"].Amount is None and got["P1"].BMI == 22.5


def test_unknown_concepts_find_nobody(spark):
    concepts = [row for row in TABLES["concept_name"] if row[1] != "Coded Diagnosis"]
    tables = clinical_tables(spark, concept_name=concepts)
    assert fetch(spark, "general", tables=tables).count() == 0
    assert fetch(spark, "diabetes", tables=tables).count() == 0


def test_pair_counts_equal_the_pairs(spark, rows):
    tables = clinical_tables(spark)
    cohort = datasets.find_cohort(tables, datasets.DIABETES_CONCEPTS, *YEAR, False)
    variables = list(datasets.DIABETES_VARIABLES)
    pairs = (
        datasets.observations(tables, variables)
        .join(datasets.patient_dim(tables, AS_OF), "person_id")
        .join(datasets.cohort_visits(tables, cohort).withColumnRenamed("patient_id", "person_id"), "person_id")
        .groupBy("person_id", "name")
        .count()
    )
    assert rows(datasets.patient_visit_pairs(tables, cohort, variables)) == rows(pairs)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_same_rows_with_and_without_broadcasts(spark, rows, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert {row.ID: row.Amount for row in fetch(spark, "diabetes").collect()}["P1"] == 10.25
        assert fetch(spark, "general").count() == 18
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_person_with_a_third_of_all_rows(spark):
    """A test patient with thousands of diagnoses and measurements changes no other row."""
    base = by_id(fetch(spark, "diabetes"))
    many = [
        (10_000 + i, 2, 2000, 20 if i % 2 else 1, None if i % 2 else 10, float(i) if i % 2 else None,
         None, at("2017-06-01"), 0)
        for i in range(5000)
    ]
    tables = clinical_tables(spark, obs=TABLES["obs"] + many)
    got = by_id(fetch(spark, "diabetes", tables=tables))
    assert got["P1"] == base["P1"]
    assert got["P2"].BMI == 1.0
    diagnoses = fetch(spark, "general", tables=tables)
    assert diagnoses.where("ID = 'P2' and Diagnosis = 'Diabetes, Type 1'").count() == 2500


def test_user_written_dataset(spark):
    @datasets.dataset("women")
    def women(tables, start, end, fetch_all=False, as_of=None):
        return datasets.patient_dim(tables, as_of).where("Gender = 'F'")

    try:
        assert datasets.fetch("women", clinical_tables(spark), *YEAR).count() == 2
    finally:
        del datasets.DATASETS["women"]
    with pytest.raises(ValueError, match="no dataset"):
        datasets.fetch("women", clinical_tables(spark), *YEAR)
