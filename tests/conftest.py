import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verification.compare import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session(os.environ.get("TEST_CPUS", "4"))
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture()
def rows(spark):
    """Frame from a schema text and tuples."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
