import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = os.environ.get("RUNLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from runlens.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8, app_name="runlens-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    from runlens.plans.compare import duckdb_connect
    return duckdb_connect(sf_dir)
