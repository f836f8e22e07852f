import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from polyquill.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark(4, shuffle_partitions=4)


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
