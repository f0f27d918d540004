"""Where the clinical and billing tables come from.

Every source offers the same three calls and returns lazy frames, so filters and column
lists written later reach the files or the database.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from cohortspark.operators.filters import active

# The tables and columns the datasets read.
CLINICAL_COLUMNS = {
    "concept_name": "concept_id bigint, name string, concept_name_type string, voided int",
    "obs": (
        "obs_id bigint, person_id bigint, encounter_id bigint, concept_id bigint, "
        "value_coded bigint, value_numeric double, value_text string, "
        "obs_datetime timestamp_ntz, voided int"
    ),
    "person": "person_id bigint, gender string, birthdate date, voided int",
    "person_address": (
        "person_id bigint, county_district string, state_province string, voided int"
    ),
    "patient_identifier": "patient_id bigint, identifier string, identifier_type int, voided int",
    "encounter": "encounter_id bigint, visit_id bigint, uuid string, patient_id bigint, voided int",
    "visit": "visit_id bigint, patient_id bigint, date_started timestamp_ntz, voided int",
}
BILLING_COLUMNS = {
    "sale_order_line": "order_id bigint, external_id string",
    "sale_order": "id bigint, amount_total double, care_setting string",
}
# Tables that one task may read, unless a source names others.
SMALL_TABLES = ("concept_name",)


def tables_named_in(query: str) -> list[str]:
    words = set(re.findall(r"\w+", query))
    return [name for name in CLINICAL_COLUMNS | BILLING_COLUMNS if name in words]


class Tables:
    """Base of all sources; a subclass only has to provide ``read``."""

    spark: SparkSession
    has_billing = True

    def read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def clinical(self, name: str) -> DataFrame:
        """Rows of a clinical table that are not voided."""
        if name not in CLINICAL_COLUMNS:
            raise ValueError(f"no clinical table {name!r}")
        return active(self.read(name))

    def billing(self, name: str) -> DataFrame:
        """A billing table; empty with the right columns when there is no billing database."""
        if name not in BILLING_COLUMNS:
            raise ValueError(f"no billing table {name!r}")
        if not self.has_billing:
            return self.spark.createDataFrame([], BILLING_COLUMNS[name])
        return self.read(name)

    def sql(self, query: str) -> DataFrame:
        """A raw SQL query over the tables it names."""
        names = tables_named_in(query)
        catalog = self.spark.catalog
        views = {table.name for table in catalog.listTables() if table.isTemporary}
        before = {name: self.spark.table(name) for name in names if name in views}
        for name in names:
            self.read(name).createOrReplaceTempView(name)
        try:
            return self.spark.sql(query)
        finally:
            # the query is resolved by now: the user's own views come back, no other stays
            for name in names:
                catalog.dropTempView(name)
                if name in before:
                    before[name].createOrReplaceTempView(name)


class ParquetTables(Tables):
    """One Parquet file or folder per table under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, has_billing: bool = True):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.has_billing = has_billing
        self._opened: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self._opened[name]


class FrameTables(Tables):
    """Tables given as data frames, by name."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        self.spark = spark
        self.frames = frames
        self.has_billing = "sale_order" in frames

    def read(self, name: str) -> DataFrame:
        return self.frames[name]


@dataclass(frozen=True)
class EqualShares:
    """A split into ``partitions`` reads of about as many rows each, by the order of ``column``.

    The database finds where each share begins. Any type that it can sort will do: numbers, dates, text.
    """

    column: str
    partitions: int

    def bounds_query(self, table: str) -> str:
        tiles = f"select {self.column} as bound, ntile({self.partitions}) over (order by {self.column}) as tile from {table}"
        return f"select min(bound) as bound from ({tiles} where {self.column} is not null) as tiles group by tile order by 1"

    def predicates(self, bounds: Sequence[object]) -> list[str]:
        return range_predicates(self.column, sorted(set(bounds))[1:])


def sql_literal(value: object) -> str:
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} is no bound")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, bounds: Sequence[object]) -> list[str]:
    """Conditions that cut a table at ``bounds``, in ascending order; NULL goes with the first part."""
    if not bounds:
        return ["1 = 1"]
    cuts = [sql_literal(bound) for bound in bounds]
    inner = [f"{column} >= {low} and {column} < {high}" for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    return [f"{column} < {cuts[0]} or {column} is null", *inner, f"{column} >= {cuts[-1]}"]


def hex_predicates(column: str, partitions: int) -> list[str]:
    """Conditions that cut a table by the first digits of a hexadecimal text, such as a UUID."""
    digits = 1
    while 16**digits < partitions:
        digits += 1
    return range_predicates(column, [f"{i * 16**digits // partitions:0{digits}x}" for i in range(1, partitions)])


def day_predicates(column: str, start: date, end: date, partitions: int) -> list[str]:
    """Conditions that cut a table by days, evenly from ``start`` to ``end``; the outer parts are open."""
    days = (end - start).days + 1
    cuts = {start + timedelta(days=i * days // partitions) for i in range(1, partitions)}
    return range_predicates(column, sorted(cut.isoformat() for cut in cuts if cut > start))


@dataclass
class JdbcSource:
    """Connection options of one database and how its tables are split into reads.

    ``splits`` maps a table to a list of conditions, one per read (see ``hex_predicates``, ``day_predicates``), to
    ``EqualShares``, to ``(column, lower, upper, partitions)``, or to ``(column, partitions)`` to have the
    bounds looked up. A table without an entry is only read if it is one of ``small``, by one task.
    """

    url: str
    user: str
    password: str = field(repr=False)
    driver: str
    splits: dict[str, tuple | list[str] | EqualShares] = field(default_factory=dict)
    fetch_size: int = 10_000
    small: tuple[str, ...] = SMALL_TABLES

    def options(self) -> dict[str, str]:
        return {
            "url": self.url,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
            "fetchsize": str(self.fetch_size),
            "preferTimestampNTZ": "true",
        }

    def table_options(self, name: str, bounds: tuple[int, int] | None = None) -> dict[str, str]:
        """``bounds`` go with a split that has none of its own."""
        options = self.options() | {"dbtable": name}
        split = self.splits.get(name)
        if isinstance(split, tuple):
            column, partitions = split[0], split[-1]
            options |= split_options(column, *(split[1:3] if len(split) == 4 else bounds), partitions)
        elif split is None and name not in self.small:
            raise ValueError(f"{name!r} is too large for one task; give it an entry in splits or name it in small")
        return options


def split_options(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


class JdbcTables(Tables):
    """Clinical tables from one database, billing tables from an optional second one."""

    def __init__(
        self, spark: SparkSession, clinical: JdbcSource, billing: JdbcSource | None = None
    ):
        self.spark = spark
        self.clinical_source = clinical
        self.billing_source = billing
        self.has_billing = billing is not None

    def source_of(self, name: str) -> JdbcSource:
        if name in CLINICAL_COLUMNS:
            return self.clinical_source
        if self.billing_source is None:
            raise ValueError(f"{name!r} needs the billing database")
        return self.billing_source

    def read(self, name: str) -> DataFrame:
        source = self.source_of(name)
        split = source.splits.get(name)
        if isinstance(split, EqualShares):
            found = self._load(source.options() | {"query": split.bounds_query(name)}).collect()
            return self._load_parts(source, name, split.predicates([row[0] for row in found]))
        if isinstance(split, list):
            return self._load_parts(source, name, split)
        looked_up = isinstance(split, tuple) and len(split) == 2
        return self._load(source.table_options(name, self._bounds(source, split[0], name) if looked_up else None))

    def sql(self, query: str, split: tuple | None = None) -> DataFrame:
        """Runs in the billing database when the query names one of its tables.

        ``split``: a column of the result with its bounds and the number of reads, or with that number alone to
        have the bounds looked up in the result; without one the result comes through one task.
        """
        billing = any(name in BILLING_COLUMNS for name in tables_named_in(query))
        source = self.source_of("sale_order" if billing else "obs")
        if split is None:
            return self._load(source.options() | {"query": query})
        result = f"({query}) as result"
        if len(split) == 2:
            split = (split[0], *self._bounds(source, split[0], result), split[1])
        return self._load(source.options() | {"dbtable": result} | split_options(*split))

    def _bounds(self, source: JdbcSource, column: str, table: str) -> tuple[int, int]:
        least = f"select min({column}) as least, max({column}) as greatest from {table}"
        found = self._load(source.options() | {"query": least}).first()
        return found[0] or 0, found[1] or 0

    def _load(self, options: dict[str, str]) -> DataFrame:
        return self.spark.read.format("jdbc").options(**options).load()

    def _load_parts(self, source: JdbcSource, name: str, predicates: list[str]) -> DataFrame:
        options = source.options()
        return self.spark.read.jdbc(options.pop("url"), name, predicates=predicates, properties=options)
