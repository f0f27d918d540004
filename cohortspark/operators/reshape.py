"""Wide to long, long to wide, and typing of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortspark.operators.filters import quoted

# How a number and a logical are written in text columns.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"
TRUE_WORDS = ["T", "TRUE", "true", "True"]
FALSE_WORDS = ["F", "FALSE", "false", "False"]


def plain_text(value: Column) -> Column:
    """A number as text, whole numbers without a decimal point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def unpivot_values(df: DataFrame, ids: Sequence[str], prefix: str = "value_") -> DataFrame:
    """``ids, Key, Value``: one row per present value of the columns starting with ``prefix``."""
    names = [name for name in df.columns if name.startswith(prefix)]
    if not names:
        raise ValueError(f"no column starts with {prefix!r}")
    texts = [
        (quoted(name) if isinstance(df.schema[name].dataType, StringType) else plain_text(quoted(name)))
        .alias(name)
        for name in names
    ]
    wide = df.select(*map(quoted, ids), *texts)
    long = wide.unpivot([quoted(i) for i in ids], [quoted(name) for name in names], "Key", "Value")
    return long.where(F.col("Value").isNotNull())


def pivot_variables(
    df: DataFrame,
    keys: Sequence[str],
    variables: dict[str, str],
    name: str = "name",
    number: str = "value_numeric",
    text: str = "value_text",
) -> DataFrame:
    """One row per group of ``keys`` and one column per variable, of its declared type.

    Expects at most one row per group and variable. A number wins over a text when a row
    holds both; a variable a group does not have is NULL.
    """
    as_type = {
        "double": F.coalesce(quoted(number), F.expr(f"try_cast(`{text}` as double)")),
        "string": F.coalesce(plain_text(quoted(number)), quoted(text)),
    }
    cells = [
        F.max(F.when(quoted(name) == variable, as_type[kind])).alias(variable)
        for variable, kind in variables.items()
    ]
    return df.groupBy(*map(quoted, keys)).agg(*cells)


def retype(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast text columns to logical, int or double where every present value allows it.

    One aggregation over all of ``columns`` decides; it returns a single row of flags.
    """
    flags = []
    for i, column in enumerate(columns):
        text = quoted(column)
        logical = text.isin(TRUE_WORDS + FALSE_WORDS)
        fits_int = F.expr(f"try_cast(`{column}` as int)").isNotNull()
        whole = F.when(text.isNotNull(), text.rlike(WHOLE) & fits_int)
        flags += [
            F.coalesce(F.bool_and(test), F.lit(True)).alias(f"{kind}{i}")
            for kind, test in (
                ("logical", logical),
                ("whole", whole),
                ("number", text.rlike(NUMBER)),
            )
        ]
    found = df.agg(*flags).first()
    for i, column in enumerate(columns):
        text = quoted(column)
        if found[f"logical{i}"]:
            df = df.withColumn(column, text.isin(TRUE_WORDS))
        elif found[f"whole{i}"]:
            df = df.withColumn(column, F.trim(text).cast("int"))
        elif found[f"number{i}"]:
            df = df.withColumn(column, F.trim(text).cast("double"))
    return df
