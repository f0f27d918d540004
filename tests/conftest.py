import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortspark import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        spark__master="local[8]",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__sql__maxMetadataStringLength="10000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return SMALL


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""

    def sorted_rows(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(row) for row in picked.collect()), key=repr)

    return sorted_rows
