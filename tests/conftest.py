import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetbook.plans.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="fleetbook-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    from fleetbook.sources.fixtures import shared_tables
    return shared_tables(spark, SF_SMALL)
