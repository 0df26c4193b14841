import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stallworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate Column expressions over literal rows: one(rows, schema, *columns) -> list of tuples."""

    def run(rows, schema, *columns):
        frame = spark.createDataFrame(rows, schema)
        named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
        return [tuple(r) for r in frame.select(*named).collect()]

    return run
