import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from fleetlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(app="tests")


@pytest.fixture
def few_partitions(spark):
    """Streams over a handful of keys: a state store for each of two partitions is enough."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
