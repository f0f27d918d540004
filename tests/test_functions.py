"""Scalar expressions against hand-computed answers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import cohortspark.functions as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def day(text):
    return F.lit(text).cast("date")


def moment(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("as_of", "years"), [("2001-02-28", 0), ("2001-03-01", 1), ("2000-02-29", 0), ("2004-02-29", 4)]
)
def test_leap_day_age(spark, as_of, years):
    assert one(spark, X.age_years(day("2000-02-29"), day(as_of))) == years


def test_age_of_unknown_birthdate(spark):
    assert one(spark, X.age_years(day(None), day("2020-01-01"))) is None


@pytest.mark.parametrize(
    ("part", "whole", "percent"),
    [(1, 800, 0.12), (3, 800, 0.38), (1, 3, 33.33), (2, 3, 66.67), (5, 5, 100.0), (0, 7, 0.0),
     (999999999999, 1000000000000, 100.0), (1, 20000, 0.0), (3, 20000, 0.02)],
)
def test_round_percent(spark, part, whole, percent):
    assert one(spark, X.round_percent(F.lit(part), F.lit(whole))) == percent


def test_parsing(spark):
    assert one(spark, X.parse_datetime(F.lit("2017-01-01"))) is None
    assert one(spark, X.parse_datetime(F.lit("2017-01-02 03:04:05"))) == datetime(2017, 1, 2, 3, 4, 5)
    assert one(spark, X.parse_date(F.lit("2017-01-02"))) == date(2017, 1, 2)
    assert one(spark, X.parse_date(F.lit("2017-13-02"))) is None


@pytest.mark.parametrize(
    ("interval", "start", "label"),
    [("Years", datetime(2017, 1, 1), "2017"), ("Quarters", datetime(2017, 4, 1), "Apr-2017"),
     ("Months", datetime(2017, 5, 1), "May-2017")],
)
def test_buckets(spark, interval, start, label):
    bucket = X.bucket(moment("2017-05-09 23:59:59"), interval)
    assert one(spark, bucket) == start
    assert one(spark, X.bucket_label(bucket, interval)) == label


def test_unknown_interval():
    with pytest.raises(ValueError, match="interval"):
        X.bucket(F.lit(None), "Weeks")


def test_buckets_ignore_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # Midnight did not exist there on this day.
        assert one(spark, X.bucket(moment("2017-10-15 00:30:00"), "Months")) == datetime(2017, 10, 1)
        assert one(spark, X.ceil_year(moment("2017-10-15 00:30:00"))) == datetime(2018, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ceil_year(spark):
    assert one(spark, X.ceil_year(moment("2017-01-01 00:00:00"))) == datetime(2017, 1, 1)
    assert one(spark, X.ceil_year(moment("2017-01-01 00:00:01"))) == datetime(2018, 1, 1)


def test_day_arithmetic(spark):
    assert one(spark, X.add_days(day("2016-02-28"), 1)) == date(2016, 2, 29)
    assert one(spark, X.range_start_default(day("2017-01-01"))) == date(2016, 1, 2)


def test_ranges_and_missing(spark):
    assert one(spark, X.if_between(F.lit(5.0), 0, 5, "low")) == "low"
    assert one(spark, X.if_between(F.lit(5.1), 0, 5, "low")) is None
    assert one(spark, X.if_between(F.lit(None).cast("double"), 0, 5, "low")) is None
    assert one(spark, X.any_present(F.lit(None), F.lit(1))) is True
    assert one(spark, X.is_missing(F.lit(None))) is True


def test_strict_sum(spark, rows):
    amounts = [("v1", "OPD", 1.0), ("v1", "OPD", None), ("v2", "IPD", 2.5), ("v3", "IPD", 0.1),
               ("v3", "IPD", 0.2)]
    df = spark.createDataFrame(amounts, "visit string, setting string, amount double")
    summed = df.groupBy("visit", "setting").agg(X.strict_sum(F.col("amount")).alias("sum"))
    assert rows(summed) == [("v1", "OPD", None), ("v2", "IPD", 2.5), ("v3", "IPD", 0.3)]
