from cohortspark.sources.export import export_csv, read_exported_csv
from cohortspark.sources.star_schema import StarSchemaTables
from cohortspark.sources.tables import (
    EqualShares,
    FrameTables,
    JdbcSource,
    JdbcTables,
    ParquetTables,
    Tables,
    day_predicates,
    hex_predicates,
    range_predicates,
)

__all__ = [
    "EqualShares",
    "FrameTables",
    "JdbcSource",
    "JdbcTables",
    "ParquetTables",
    "StarSchemaTables",
    "Tables",
    "day_predicates",
    "export_csv",
    "hex_predicates",
    "range_predicates",
    "read_exported_csv",
]
