"""Sources and exports."""

from datetime import date
from pathlib import Path

import duckdb
import pytest
from clinical import TABLES, clinical_tables

from cohortspark.operators.crosstab import crosstab_wide
from cohortspark.session import materialize, new_path, release, shared_dir
from cohortspark.sources import (
    EqualShares,
    JdbcSource,
    JdbcTables,
    ParquetTables,
    day_predicates,
    export_csv,
    hex_predicates,
    read_exported_csv,
)


def test_parquet_tables(spark, rows):
    folder = new_path(spark, "tables")
    made = clinical_tables(spark)
    for name in TABLES:
        made.read(name).write.parquet(f"{folder}/{name}")
    tables = ParquetTables(spark, folder)
    assert tables.clinical("person").count() == 4
    assert tables.billing("sale_order").count() == 5
    spark.range(3).createOrReplaceTempView("sale_order_line")
    assert len(rows(tables.sql("SELECT distinct order_id, external_id from sale_order_line"))) == 6
    assert tables.sql("select count(person.person_id) as n from person").first().n == 5
    views = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    assert "sale_order_line" in views and "person" not in views
    assert spark.table("sale_order_line").count() == 3
    spark.catalog.dropTempView("sale_order_line")
    assert ParquetTables(spark, folder, has_billing=False).billing("sale_order").count() == 0
    with pytest.raises(ValueError, match="no clinical table"):
        tables.clinical("sale_order")
    with pytest.raises(ValueError, match="no billing table"):
        tables.billing("person")


class Recorder:
    """Stands in for a session; keeps the options a read would have used."""

    def __init__(self):
        self.read = self

    def format(self, name):
        self.name = name
        return self

    def options(self, **options):
        self.used = options
        return self

    def load(self):
        return self.used


def test_jdbc_options():
    clinical = JdbcSource("jdbc:mysql://h/c", "u", "secret", "com.mysql.cj.jdbc.Driver",
                          splits={"obs": ("obs_id", 1, 1_000_000, 64)})
    billing = JdbcSource("jdbc:postgresql://h/b", "u", "secret", "org.postgresql.Driver", small=("sale_order",))
    tables = JdbcTables(Recorder(), clinical, billing)
    obs = tables.read("obs")
    assert obs["dbtable"] == "obs" and obs["url"] == "jdbc:mysql://h/c"
    assert (obs["partitionColumn"], obs["lowerBound"], obs["upperBound"], obs["numPartitions"]) == (
        "obs_id", "1", "1000000", "64",
    )
    assert "partitionColumn" not in tables.read("concept_name")
    assert tables.read("sale_order")["url"] == "jdbc:postgresql://h/b"
    query = tables.sql("SELECT distinct order_id, external_id from sale_order_line")
    assert query["url"] == "jdbc:postgresql://h/b" and "dbtable" not in query
    assert tables.sql("select count(*) as n from obs")["url"] == "jdbc:mysql://h/c"
    assert "secret" not in repr(clinical)
    for name in ("encounter", "person", "visit", "person_address", "patient_identifier", "sale_order_line"):
        with pytest.raises(ValueError, match="too large"):
            tables.read(name)
    split = tables.sql("select id, amount_total from sale_order", ("id", 1, 9, 3))
    assert split["dbtable"] == "(select id, amount_total from sale_order) as result"
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", "3") and "query" not in split
    with pytest.raises(ValueError, match="billing"):
        JdbcTables(Recorder(), clinical).read("sale_order")


def test_jdbc_bounds_are_looked_up():
    class Bounds(Recorder):
        def load(self):
            query = self.used.get("query")
            return self if query == "select min(obs_id) as least, max(obs_id) as greatest from obs" else self.used

        def first(self):
            return (5, 500)

    source = JdbcSource("jdbc:mysql://h/c", "u", "p", "d", splits={"obs": ("obs_id", 16)})
    options = JdbcTables(Bounds(), source).read("obs")
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("5", "500", "16")


class Parts(Recorder):
    """Keeps what a read by conditions is given; answers look-ups of bounds."""

    asked = None
    found: list = []

    def load(self):
        self.asked = self.used.get("query", self.asked)
        return self if "query" in self.used else self.used

    def collect(self):
        return [(bound,) for bound in self.found]

    def first(self):
        return (3, 40)

    def jdbc(self, url, table, predicates, properties):
        return url, table, predicates, properties


def test_jdbc_tables_without_a_number_are_split_by_conditions():
    by_hex = hex_predicates("external_id", 4)
    by_day = day_predicates("date_started", date(2020, 1, 1), date(2020, 1, 4), 2)
    source = JdbcSource("jdbc:mysql://h/c", "u", "p", "d", splits={"encounter": by_hex, "visit": by_day})
    url, table, predicates, properties = JdbcTables(Parts(), source).read("encounter")
    assert (url, table, properties["fetchsize"], "dbtable" in properties) == ("jdbc:mysql://h/c", "encounter", "10000", False)
    assert predicates == ["external_id < '4' or external_id is null", "external_id >= '4' and external_id < '8'",
                          "external_id >= '8' and external_id < 'c'", "external_id >= 'c'"]
    assert JdbcTables(Parts(), source).read("visit")[2] == [
        "date_started < '2020-01-03' or date_started is null", "date_started >= '2020-01-03'",
    ]
    assert len(hex_predicates("u", 100)) == 100 and hex_predicates("u", 1) == ["1 = 1"]


def test_jdbc_shares_of_equal_size():
    source = JdbcSource("jdbc:mysql://h/c", "u", "p", "d", splits={"obs": EqualShares("obs_id", 3)})
    spark = Parts()
    spark.found = [1, 500, 500]
    assert JdbcTables(spark, source).read("obs")[2] == ["obs_id < 500 or obs_id is null", "obs_id >= 500"]
    assert "ntile(3) over (order by obs_id)" in spark.asked
    spark.found = ["a", "it's"]
    assert JdbcTables(spark, source).read("obs")[2][1] == "obs_id >= 'it''s'"
    spark.found = []
    assert JdbcTables(spark, source).read("obs")[2] == ["1 = 1"]


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_parts_of_equal_shares_hold_every_row_once(folder, parts):
    """The bounds query and the conditions on a real engine, with NULL, ties and text."""
    db = duckdb.connect()
    db.execute("create table t as select nullif(range % 13, 5) as n, nullif(chr((97 + range % 7)::int), 'c') as s from range(300)")
    for column in ("n", "s"):
        split = EqualShares(column, parts)
        bounds = [row[0] for row in db.execute(split.bounds_query("t")).fetchall()]
        counts = [db.execute(f"select count(*) from t where {p}").fetchone()[0] for p in split.predicates(bounds)]
        assert sum(counts) == 300 and len(counts) <= parts


def test_bounds_of_a_query_are_looked_up():
    spark = Parts()
    tables = JdbcTables(spark, JdbcSource("c", "u", "p", "d"), JdbcSource("b", "u", "p", "d"))
    options = tables.sql("select id, amount_total from sale_order", ("id", 5))
    assert spark.asked == "select min(id) as least, max(id) as greatest from (select id, amount_total from sale_order) as result"
    assert options["dbtable"] == "(select id, amount_total from sale_order) as result"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("3", "40", "5")


def test_exported_csv_reads_back(spark, rows):
    df = spark.createDataFrame(
        [("a,b", 1.5, None), ('say "x"', None, "line\nbreak"), ("", 2.0, "ü"), (" lead", 3.0, "trail\t "),
         ("\r\n", 4.0, '"'), (None, None, "\\")],
        "`Care Setting` string, n double, t string",
    )
    path = new_path(spark, "csv")
    export_csv(df, path)
    text = "".join(row.value for row in spark.read.text(path, wholetext=True).collect())
    assert "Care Setting" in text and "NA" in text
    assert rows(read_exported_csv(spark, path, df.schema)) == rows(df)


def test_exported_crosstab(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "f string, g string")
    wide = crosstab_wide(df, "f", "g")
    path = new_path(spark, "csv")
    export_csv(wide, path)
    assert rows(read_exported_csv(spark, path, wide.schema)) == [("a", 1, 1), ("b", 1, 0)]


def test_written_tables_go_to_the_shared_folder(spark, rows):
    df = spark.range(5).selectExpr("id as `a b`", "current_date() as d")
    stored = materialize(df, "label")
    assert stored.inputFiles()[0].startswith(f"file://{shared_dir(spark)}/label-")
    assert rows(stored, "`a b`") == [(i,) for i in range(5)]


def test_release_leaves_nothing_behind(spark):
    release(spark)
    stored = materialize(spark.range(5), "label")
    place = Path(stored.inputFiles()[0].removeprefix("file://")).parent
    assert stored.count() == 5 and place.exists()
    release(spark)
    assert not place.exists()


class Settings:
    """Stands in for a session; keeps its settings."""

    def __init__(self, **settings):
        self.settings = {key.replace("__", "."): value for key, value in settings.items()}
        self.conf = self

    def get(self, key, *default):
        return self.settings.get(key, *default)


def test_without_a_shared_folder_only_a_local_master_uses_the_warehouse():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Settings(spark__master="spark://h:7077", spark__sql__warehouse__dir="/w"))
    assert shared_dir(Settings(spark__checkpoint__dir="hdfs:/c/")) == "hdfs:/c"
    assert shared_dir(Settings(spark__master="local[2]", spark__sql__warehouse__dir="hdfs:/w")) == "hdfs:/w/intermediate"
