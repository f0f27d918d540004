"""Clinical and billing tables derived from an order/line-item star schema.

Customers become persons, orders become visits and line items become encounters with one
observation each. Missing values, voided rows, tied times, duplicate order lines and
unbilled encounters are put in by fixed expressions, so every rule about them is exercised.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import materialize
from cohortspark.sources.tables import Tables

# The concept dictionary (concept_id, name, concept_name_type, voided).
CONCEPTS = [
    (1, "Coded Diagnosis", "FULLY_SPECIFIED", 0),
    (1, "Dx", "SHORT", 0),
    (10, "Diabetes, Type 1", "FULLY_SPECIFIED", 0),
    (11, "Diabetes, Type 2", "FULLY_SPECIFIED", 0),
    (12, "Diabetes I, uncomplicated", "FULLY_SPECIFIED", 0),
    (13, "Diabetes, Juvenile", "FULLY_SPECIFIED", 0),
    (14, "Diabetes II, uncomplicated", "FULLY_SPECIFIED", 0),
    (15, "Hypertension", "FULLY_SPECIFIED", 0),
    (16, "Malaria", "FULLY_SPECIFIED", 0),
    (17, "Asthma", "FULLY_SPECIFIED", 0),
    (17, "Asthma (old)", "FULLY_SPECIFIED", 1),
    (20, "BMI", "FULLY_SPECIFIED", 0),
    (21, "BMI Status", "FULLY_SPECIFIED", 0),
    (22, "FBS", "FULLY_SPECIFIED", 0),
    (23, "Hb1AC", "FULLY_SPECIFIED", 0),
    (24, "Systolic", "FULLY_SPECIFIED", 0),
    (25, "Diastolic", "FULLY_SPECIFIED", 0),
]

GENDER = "case when c_custkey % 97 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end"
BIRTHDATE = (
    "case when c_custkey % 61 = 0 then date '1996-02-29' "
    "else make_date(cast(1940 + c_custkey % 65 as int), cast(1 + c_custkey % 12 as int), "
    "cast(1 + c_custkey % 28 as int)) end"
)
CONCEPT_ID = (
    "case when l_linenumber <= 2 then 1 when l_linenumber = 3 then 20 "
    "when l_linenumber = 4 and l_orderkey % 2 = 0 then 22 when l_linenumber = 4 then 23 "
    "when l_linenumber = 5 then 24 when l_linenumber = 6 then 25 else 21 end"
)
VALUE_TEXT = (
    "case when l_linenumber = 7 then case when q < 18 then 'Underweight' "
    "when q < 25 then 'Normal' when q < 35 then 'Overweight' else 'Obese' end end"
)
LINE_ID = "l_orderkey * 10 + l_linenumber"
SALE_ID = "l_orderkey * 10 + l_linenumber % 4"
# The first, third and fifth line of an order are its billed encounters.
BILLED = "l_linenumber in (1, 3, 5)"


class StarSchemaTables(Tables):
    """Reads ``<folder>/<table>.parquet`` and derives the clinical and billing tables."""

    def __init__(
        self, spark: SparkSession, folder: str, has_billing: bool = True, staged: bool = False
    ):
        """``staged`` derives the lines once and writes them, for datasets that read the
        observations and encounters several times."""
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.has_billing = has_billing
        self.staged = staged
        self._base: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A table of the star schema; its file is opened once to learn its columns."""
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._base[name]

    def read(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def concept_name(self) -> DataFrame:
        rows = ", ".join(
            f"({concept_id}L, '{name}', '{kind}', {voided})"
            for concept_id, name, kind, voided in CONCEPTS
        )
        return self.spark.sql(
            f"select * from values {rows} as t(concept_id, name, concept_name_type, voided)"
        )

    @cached_property
    def person(self) -> DataFrame:
        return self.base("customer").selectExpr(
            "c_custkey as person_id",
            f"{GENDER} as gender",
            f"{BIRTHDATE} as birthdate",
            "case when c_custkey % 50 = 49 then 1 else 0 end as voided",
        )

    @cached_property
    def person_address(self) -> DataFrame:
        return self._customer_places().selectExpr(
            "c_custkey as person_id",
            "n_name as county_district",
            "case when c_custkey % 83 = 0 then null else r_name end as state_province",
            "case when c_custkey % 70 = 69 then 1 else 0 end as voided",
        )

    @cached_property
    def patient_identifier(self) -> DataFrame:
        main = "named_struct('identifier', c_name, 'identifier_type', 3)"
        other = (
            "named_struct('identifier', concat('ALT-', cast(c_custkey as string)), "
            "'identifier_type', 2)"
        )
        issued = f"case when c_custkey % 5 = 0 then array({main}, {other}) else array({main}) end"
        return (
            self.base("customer")
            .selectExpr("c_custkey as patient_id", f"inline({issued})")
            .withColumn("voided", F.lit(0))
        )

    @cached_property
    def visit(self) -> DataFrame:
        return self.base("orders").selectExpr(
            "o_orderkey as visit_id",
            "o_custkey as patient_id",
            "o_orderdate as date_started",
            "case when o_orderkey % 100 = 99 then 1 else 0 end as voided",
        )

    @cached_property
    def encounter(self) -> DataFrame:
        return self._lines.selectExpr(
            f"{LINE_ID} as encounter_id",
            "l_orderkey as visit_id",
            f"concat('enc-', cast({LINE_ID} as string)) as uuid",
            "o_custkey as patient_id",
            f"case when ({LINE_ID}) % 41 = 0 then 1 else 0 end as voided",
        )

    @cached_property
    def obs(self) -> DataFrame:
        return self._lines.selectExpr(
            f"{LINE_ID} as obs_id",
            "o_custkey as person_id",
            f"{LINE_ID} as encounter_id",
            f"cast({CONCEPT_ID} as bigint) as concept_id",
            "case when l_linenumber <= 2 then 10 + l_orderkey % 8 end as value_coded",
            f"case when l_linenumber between 3 and 6 and ({LINE_ID}) % 11 <> 0 then q end"
            " as value_numeric",
            f"{VALUE_TEXT} as value_text",
            "o_orderdate as obs_datetime",
            f"case when ({LINE_ID}) % 37 = 0 then 1 else 0 end as voided",
        )

    @cached_property
    def sale_order_line(self) -> DataFrame:
        return (
            self.base("lineitem")
            .where(BILLED)
            .selectExpr(
                f"{SALE_ID} as order_id",
                f"concat('enc-', cast({LINE_ID} as string)) as external_id",
            )
        )

    @cached_property
    def sale_order(self) -> DataFrame:
        return (
            self.base("lineitem")
            .where(BILLED)
            .selectExpr(
                f"{SALE_ID} as id",
                f"case when ({SALE_ID}) % 13 = 0 then null "
                f"else cast((({SALE_ID}) * 7919) % 500000 as double) / 100 end as amount_total",
                "case l_orderkey % 3 when 0 then 'OPD' when 1 then 'IPD' end as care_setting",
            )
            .distinct()
        )

    @cached_property
    def visits(self) -> DataFrame:
        """One flat row per visit, ready for charts."""
        orders = self.base("orders")
        patients = self._customer_places()
        return orders.join(patients, orders.o_custkey == patients.c_custkey).selectExpr(
            "c_name as ID",
            f"{GENDER} as Gender",
            "n_name as District",
            "r_name as State",
            "o_orderdate as `Visit Date`",
            "o_orderpriority as Diagnosis",
            "o_orderstatus as `Care Setting`",
            "o_totalprice as Amount",
        )

    def _customer_places(self) -> DataFrame:
        customer, nation, region = map(self.base, ("customer", "nation", "region"))
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
            region, nation.n_regionkey == region.r_regionkey
        )

    @cached_property
    def _lines(self) -> DataFrame:
        """One row per line number of an order: the raw lines repeat some numbers."""
        orders = self.base("orders")
        lines = (
            self.base("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min("l_quantity").alias("q"))
        )
        visited = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            "l_orderkey", "l_linenumber", "q", "o_custkey", "o_orderdate"
        )
        return materialize(visited, "lines") if self.staged else visited
