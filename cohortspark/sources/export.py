"""CSV export of flat tables and cross-tabulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


OPTIONS = {
    "header": True,
    "nullValue": "NA",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(df: DataFrame, path: str) -> None:
    """Write ``df`` as a folder of CSV parts with a header each; NULL is written as NA."""
    df.write.options(**OPTIONS).csv(path)


def read_exported_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Reads what ``export_csv`` wrote; texts may hold line breaks, so a part is one split.

    A carriage return is only text when the line separator is named.
    """
    return spark.read.options(**OPTIONS, multiLine=True, lineSep="\n").schema(schema).csv(path)
