"""A small set of clinical and billing tables, with every awkward case once."""

from datetime import date, datetime

from cohortspark.sources import FrameTables
from cohortspark.sources.tables import BILLING_COLUMNS, CLINICAL_COLUMNS

FULL = "FULLY_SPECIFIED"


def at(text):
    return datetime.fromisoformat(text)


TABLES = {
    "concept_name": [
        (1, "Coded Diagnosis", FULL, 0), (1, "Dx", "SHORT", 0),
        (10, "Diabetes, Type 1", FULL, 0), (11, "Diabetes, Type 2", FULL, 0),
        (15, "Hypertension", FULL, 0), (16, "Malaria", FULL, 0), (16, "Paludism", FULL, 0),
        (20, "BMI", FULL, 0), (21, "BMI Status", FULL, 0), (22, "FBS", FULL, 0),
        (23, "Hb1AC", FULL, 0), (24, "Systolic", FULL, 0), (25, "Diastolic", FULL, 0),
        (26, "Systolic", FULL, 1),
    ],
    "person": [
        (1, "F", date(2000, 2, 29), 0), (2, "M", date(1980, 6, 1), 0),
        (3, None, date(1990, 1, 1), 0), (4, "F", date(1970, 1, 1), 1),
        (5, "M", date(1960, 1, 1), 0),
    ],
    "person_address": [
        (1, "North", "S1", 0), (1, "East", None, 0), (2, "South", "S2", 0), (3, "West", "S3", 0),
        (4, "West", "S3", 0), (5, "Old", "S9", 1),
    ],
    "patient_identifier": [
        (1, "P1", 3, 0), (1, "ALT1", 2, 0), (2, "P2", 3, 0), (2, "SHARED", 3, 0),
        (3, "SHARED", 3, 0), (4, "P4", 3, 0), (5, "P5", 3, 0),
    ],
    # visit 100 of person 1, 200 and 201 of person 2, 300 of person 3
    "visit": [
        (100, 1, at("2017-03-01"), 0), (200, 2, at("2017-05-01"), 0),
        (201, 2, at("2017-01-15"), 0), (300, 3, at("2017-04-01"), 0),
    ],
    "encounter": [
        (1000, 100, "e1000", 1, 0), (1001, 100, "e1001", 1, 0), (1002, 100, "e1002", 1, 0),
        (2000, 200, "e2000", 2, 0), (2010, 201, "e2010", 2, 0), (3000, 300, "e3000", 3, 0),
        (3001, 300, "e3001", 3, 1),
    ],
    "obs": [
        # obs_id, person, encounter, concept, coded, number, text, time, voided
        (1, 1, 1000, 1, 10, None, None, at("2017-03-01 09:00:00"), 0),
        (2, 1, 1001, 1, 11, None, None, at("2017-03-01 10:00:00"), 0),
        (3, 1, 1000, 1, 16, None, None, at("2017-03-01 09:00:00"), 0),
        (4, 1, 1000, 1, 16, None, None, at("2017-03-01 09:00:00"), 0),
        (5, 2, 2000, 1, 10, None, None, at("2017-05-01"), 0),
        (6, 2, 2010, 1, 10, None, None, at("2017-01-31 23:59:59"), 0),
        (7, 3, 3000, 1, 15, None, None, at("2017-04-01"), 0),
        (8, 3, 3000, 1, 10, None, None, at("2017-04-01"), 0),
        (9, 3, 3000, 1, 10, None, None, at("2017-09-01"), 1),
        (10, 4, 1000, 1, 10, None, None, at("2017-04-01"), 0),
        (11, 2, 2000, 1, 15, None, None, None, 0),
        (12, 2, 2000, 1, 15, None, None, at("2017-05-01"), 0),
        # measurements
        (20, 1, 1000, 20, None, None, None, at("2017-03-01"), 0),
        (21, 1, 1000, 20, None, 22.5, None, at("2010-01-01"), 0),
        (22, 1, 1000, 20, None, 30.0, None, at("2017-03-01"), 0),
        (23, 1, 1000, 21, None, None, "Normal", at("2017-03-01"), 0),
        (24, 2, 2000, 22, None, 99.0, None, at("2017-05-01"), 0),
        (25, 2, 2000, 22, None, 88.0, None, at("2017-01-01"), 1),
        (26, 3, 3000, 23, None, 6.5, None, at("2017-04-01"), 0),
        (27, 3, 3000, 22, None, 77.0, None, at("2017-04-01"), 0),
        (30, 3, 3000, 24, None, 120.0, None, at("2017-04-01"), 0),
        (31, 3, 3000, 24, None, 150.0, None, at("2017-04-02"), 0),
        (32, 3, 3000, 24, None, None, None, at("2017-04-03"), 0),
        (33, 3, 3000, 25, None, 80.0, None, at("2017-04-01"), 0),
        (34, 3, 3000, 25, None, 70.0, None, at("2017-04-01"), 0),
        (35, 3, 3000, 20, None, 25.0, None, None, 0),
        (36, 2, 2000, 24, None, None, None, at("2017-05-01"), 0),
    ],
    "sale_order_line": [
        (500, "e1000"), (500, "e1000"), (500, "e1001"), (501, "e2000"), (502, "e2000"),
        (503, "e3000"), (599, None),
    ],
    "sale_order": [
        (500, 10.25, "OPD"), (501, 1.0, "IPD"), (502, None, "IPD"), (503, 7.5, None),
        (599, 3.0, "OPD"),
    ],
}
COLUMNS = CLINICAL_COLUMNS | BILLING_COLUMNS


def clinical_tables(spark, without_billing=False, **changed):
    data = TABLES | changed
    names = CLINICAL_COLUMNS if without_billing else COLUMNS
    return FrameTables(spark, {name: spark.createDataFrame(data[name], COLUMNS[name]) for name in names})
