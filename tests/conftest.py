from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablecare.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="6g")


@pytest.fixture
def frame(spark):
    """Rows with a row_id in their given order, dealt over partitions in another order."""

    def make(columns: str, rows: list[tuple], partitions: int = 3):
        schema = "row_id long, " + ", ".join(c if " " in c.strip() else f"{c.strip()} string" for c in columns.split(","))
        numbered = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        return spark.createDataFrame(numbered[::-1], schema).repartition(partitions)

    return make


@pytest.fixture
def rows():
    """The rows of a table as tuples in a stable order."""

    def listed(df, *columns):
        out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(out, key=repr)

    return listed
