import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "tickloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def chunked(spark):
    """Force the plans for large inputs, with short pieces."""
    spark.conf.set("spark.tickloom.path", "chunked")
    spark.conf.set("spark.tickloom.chunkTicks", "50")
    yield spark
    spark.conf.set("spark.tickloom.path", "auto")
    spark.conf.unset("spark.tickloom.chunkTicks")


@pytest.fixture
def trace(spark):
    """Literal values as a trace with a kept-tick mask."""
    def make(values, kept=(), series="s"):
        rows = [(series, i, float(v), i in set(kept)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "series_id string, tick long, value double, sampled boolean")
    return make
