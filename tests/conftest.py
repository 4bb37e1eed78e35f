import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from litspark.schemas import RECORD  # noqa: E402
from litspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "litspark-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def records(spark):
    """Makes records from dicts; columns not given are null, ``pdf_downloaded`` is false."""

    def make(*rows, extra="search_id string, ord bigint"):
        names = RECORD.fieldNames() + [f.split()[0] for f in extra.split(", ")]
        full = []
        for i, row in enumerate(rows):
            values = dict.fromkeys(names) | {"pdf_downloaded": False, "search_id": "s", "ord": i} | row
            full.append(tuple(values[n] for n in names))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields)
        return spark.createDataFrame(full, f"{kinds}, {extra}")

    return make


@pytest.fixture(scope="session")
def value(spark):
    """Value of a column expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]
