"""Run queries on Spark and their SQL on DuckDB over the same folder and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def row_counts(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    """Columns by name, and the rows as a multiset in that column order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def spark_rows(spark, name: str, folder: str) -> tuple[list[str], Counter]:
    df = QUERIES[name](spark, folder)
    return row_counts(df.columns, [tuple(row) for row in df.collect()])


def oracle_rows(connection, name: str) -> tuple[list[str], Counter]:
    result = connection.execute(ORACLE[name])
    return row_counts([column[0] for column in result.description], result.fetchall())


def difference(got: tuple[list[str], Counter], wanted: tuple[list[str], Counter]) -> str:
    """Empty when both are equal, else what differs."""
    if got[0] != wanted[0]:
        return f"columns {got[0]} instead of {wanted[0]}"
    if got[1] == wanted[1]:
        return ""
    extra, missing = got[1] - wanted[1], wanted[1] - got[1]
    sizes = f"{got[1].total()} rows instead of {wanted[1].total()}"
    return f"{sizes}; extra {list(extra)[:2]}; missing {list(missing)[:2]}"


def main() -> int:
    from cohortspark import get_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(ORACLE)
    spark = get_session(spark__master="local[8]", spark__sql__shuffle__partitions="8",
                        spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            got = spark_rows(spark, name, folder)
            problem = difference(got, oracle_rows(connection, name))
        except Exception as error:
            got, problem = ([], Counter()), f"{type(error).__name__}: {str(error)[:400]}"
        failed += bool(problem)
        print(f"{name}: {problem or 'ok'} ({got[1].total()} rows, {time.time() - started:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
